"""Importance of single log lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import fold_upper


def line_weight(line: Column, upper: Column | None = None) -> Column:
    """Highest weight of the level words in the line; detail lines with a level get at least the floor."""
    upper = fold_upper(line) if upper is None else upper
    level = None
    for weight in sorted(set(fv.LEVEL_WEIGHTS.values()), reverse=True):
        hit = F.lit(False)
        for word, word_weight in fv.LEVEL_WEIGHTS.items():
            if word_weight == weight:
                hit = hit | F.contains(upper, F.lit(word))
        level = F.when(hit, weight) if level is None else level.when(hit, weight)
    detail = F.lit(False)
    for prefix in fv.DETAIL_PREFIXES:
        detail = detail | F.startswith(line, F.lit(prefix))
    # greatest() skips nulls, so the floor is only offered where a level word was found
    floored = F.when(detail & level.isNotNull(), F.greatest(level, F.lit(fv.DETAIL_FLOOR))).otherwise(level)
    return F.coalesce(floored, F.lit(fv.NO_LEVEL_WEIGHT))


def scored_lines(text: Column) -> Column:
    """array<struct<i, content, weight, n_bytes>>, one element per line."""
    pairs = F.arrays_zip(
        F.split(text, "\n").alias("content"), F.split(fold_upper(text), "\n").alias("upper")
    )
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            i.alias("i"),
            p["content"].alias("content"),
            line_weight(p["content"], p["upper"]).alias("weight"),
            F.octet_length(p["content"]).alias("n_bytes"),
        ),
    )
