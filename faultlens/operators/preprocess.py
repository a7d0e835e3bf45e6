"""Log preprocessing: mask, shorten by line importance, fingerprint, tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.lines import line_weight, scored_lines
from faultlens.functions.masking import mask, mask_hits
from faultlens.functions.tagging import key_errors, retrieval_keywords
from faultlens.functions.text import log_fingerprint, token_estimate

_KEPT = "array<struct<i:int,content:string>>"


def line_weights(logs: DataFrame, text: str = "content") -> DataFrame:
    """One row per line: (all other columns), i, line, weight. ``i`` starts at 0."""
    others = [c for c in logs.columns if c != text]
    lines = logs.select(*others, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.withColumn("weight", line_weight(F.col("line")))


def truncate_lines(logs: DataFrame, text: str, out: str, max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """Keeps the first and last lines, then the weightiest lines that still fit the byte limit.

    Texts within the limit pass through untouched, so the line work is done only for oversized ones.
    Each step is its own projection: the columns are read more than once and must not be recomputed.
    """
    limit = max_tokens * fv.BYTES_PER_TOKEN
    edge = fv.EDGE_LINES
    lines = F.when(F.octet_length(text) > limit, scored_lines(F.col(text)))
    work = logs.withColumn("_lines", lines).withColumn("_n", F.size("_lines"))
    work = work.withColumn(
        "_edge", F.filter("_lines", lambda x: (x.i < edge) | (x.i >= F.col("_n") - edge))
    ).withColumn(
        "_used", F.aggregate("_edge", F.lit(0), lambda acc, x: acc + x.n_bytes + 1)
    )
    # lines that cannot fit even first are dropped before the sort
    inner = F.filter(
        "_lines",
        lambda x: (x.i >= edge) & (x.i < F.col("_n") - edge) & (F.col("_used") + x.n_bytes <= limit),
    )
    by_weight = F.array_sort(
        F.transform(inner, lambda x: F.struct((-x.weight).alias("w"), x.i, x.content, x.n_bytes))
    )
    start = F.struct(F.col("_used").alias("used"), F.array().cast(_KEPT).alias("kept"))
    fold = F.aggregate(
        by_weight,
        start,
        lambda acc, x: F.when(acc.used + x.n_bytes > limit, acc).otherwise(
            F.struct(
                (acc.used + x.n_bytes + 1).alias("used"),
                F.array_append(acc.kept, F.struct(x.i, x.content)).alias("kept"),
            )
        ),
        lambda acc: acc.kept,
    )
    work = work.withColumn("_kept", F.when(F.col("_lines").isNotNull(), fold))
    chosen = F.array_sort(
        F.concat(F.transform("_edge", lambda x: F.struct(x.i, x.content)), F.col("_kept"))
    )
    shortened = F.array_join(F.transform(chosen, lambda x: x.content), "\n")
    return work.withColumn(
        out, F.when(F.col("_lines").isNotNull(), shortened).otherwise(F.col(text))
    ).drop("_lines", "_n", "_edge", "_used", "_kept")


def preprocess(logs: DataFrame, text: str = "content", max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """Adds processed_text, original_hash, token_count and key_errors; drops the raw text."""
    masked = logs.withColumn("_masked", mask(F.col(text))).drop(text)
    short = truncate_lines(masked, "_masked", "processed_text", max_tokens)
    return (
        short.withColumn("original_hash", log_fingerprint(F.col("_masked")))
        .drop("_masked")
        .withColumn("token_count", token_estimate(F.col("processed_text")))
        .withColumn("key_errors", key_errors(F.col("processed_text")))
    )


def with_keywords(processed: DataFrame) -> DataFrame:
    """Adds the search keywords of preprocessed logs."""
    return processed.withColumn("keywords", retrieval_keywords(F.col("processed_text"), F.col("key_errors")))


def mask_counts(logs: DataFrame, text: str, group: str) -> DataFrame:
    """Hits of each masking rule per group, plus the number of texts."""
    hits = mask_hits(F.col(text))
    return logs.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_texts"),
        *[F.sum(column).alias(f"{name}_hits") for name, column in hits.items()],
    )


def key_error_counts(processed: DataFrame) -> DataFrame:
    """Logs per key error."""
    return processed.select(F.explode("key_errors").alias("key_error")).groupBy("key_error").agg(
        F.count(F.lit(1)).alias("n_logs")
    )
