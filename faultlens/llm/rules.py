"""Quality rules: cutoffs per language and source from mergeable quantile sketches, joined back to the documents."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultlens.llm.textops import blobs, slices
from faultlens.sources.stage import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
MAX_BROADCAST_GROUPS = 100_000  # cutoffs of more groups (some 100 bytes each) are joined by a shuffle
MIN_GROUP = 100  # documents that a sketch must hold to give cutoffs of its own
FENCE = 3  # distances between the quartiles that a value may lie beyond them
SALTS = 32
_BITS = 6  # leading bits that a bucket of the sketch keeps: a relative error below 1/32
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# statistic: (numerator, denominator, factor, least distance between the quartiles, whether low values fail too)
STATISTICS = {
    "symbols": ("n_symbols", "word_chars", 1000, 15, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 150, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 150, False),
    "word_length": ("word_chars", "n_words", 100, 60, True),
}


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BLANK = _class(b" \t\n\x0b\x0c\r")
_STARTS = np.arange(256) & 0xC0 != 0x80  # bytes that begin a code point
_BYTE_CLASSES = {"word_chars": _STARTS & ~_BLANK, "n_symbols": _class(SYMBOLS)}


def _windows(ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """A number for each run of ``size`` ids below ``n``, the same for equal runs only."""
    code, top = ids, n
    for k in range(1, size):
        if top * n >= 2**62:
            seen, code = np.unique(code, return_inverse=True)
            top = len(seen)
        code, top = code[:-1] * n + ids[k:], top * n
    return code


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text the numbers named in ``_COUNTS``."""
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    ids = [np.array(list(map(index.__getitem__, t.split())), np.int64) for t in texts]
    n_words = np.array([len(i) for i in ids], np.int64)
    out = {"n_words": n_words}

    points = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    for name, kind in _BYTE_CLASSES.items():
        upto = np.concatenate([[0], np.cumsum(kind[points])])
        out[name] = upto[ends[1:]] - upto[ends[:-1]]

    n_lines, n_dup = [], []
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip()]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
    out["n_lines"], out["n_dup_lines"] = np.array(n_lines, np.int64), np.array(n_dup, np.int64)

    token = np.concatenate(ids) if ids else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), n_words)
    covered = np.zeros(len(token), bool)
    if len(token) >= WINDOW:
        code = _windows(token, len(index), WINDOW)
        at = np.flatnonzero(owner[WINDOW - 1:] == owner[:1 - WINDOW])
        # equal windows side by side, those of one text in a row, as positions stay in order
        at = at[np.argsort(code[at], kind="stable")]
        same = (code[at[1:]] == code[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
        twice = np.concatenate([at[1:][same], at[:-1][same]])
        for j in range(WINDOW):
            covered[twice + j] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=len(texts))
    return out


_COUNTED = StructType([StructField(c, LongType()) for c in _COUNTS])


@F.arrow_udf(_COUNTED)
def _counts(column: pa.Array) -> pa.Array:
    texts = blobs(column)
    parts = [count_texts(texts[start:end]) for start, end in slices(map(len, texts))]
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.empty(0) for c in _COUNTS]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], list(_COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _statistic(name: str) -> Column:
    above, below, factor, *_ = STATISTICS[name]
    return F.floor(factor * F.col(above) / F.col(below)).cast("long")


def _group_key(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def counted(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text, further columns): the further columns, the keys of language and source, and the counts."""
    rest = [c for c in docs.columns if c not in ("lang", "source", "text")]
    rows = docs.select(*rest, _group_key("lang").alias("lang_key"), _group_key("source").alias("source_key"), _counts("text").alias("c"))
    return rows.select(*rest, "lang_key", "source_key", *[F.col(f"c.{c}").alias(c) for c in _COUNTS])


def bucket(value: Column) -> Column:
    """Lower edge of the sketch's bucket: values keep their ``_BITS`` leading bits."""
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - _BITS, F.lit(0))).cast("long")
    return value - value % width


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, statistic, bucket, n): quantile sketches of rows that pass the base rules, a row per bucket.

    Sketches merge by adding up ``n``; counts are added before they are shuffled, so a hot group sends a few hundred rows
    per task. A sketch has at most 2**_BITS buckets and half as many more for each further power of two.
    """
    values = F.explode(F.array(*[
        F.struct(F.lit(name).alias("statistic"), bucket(_statistic(name)).alias("bucket")) for name in STATISTICS
    ]))
    parts = rows.filter(~base_failed()).select(*keys, values.alias("v")).select(*keys, "v.*")
    return parts.groupBy(*keys, "statistic", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "statistic", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, statistic, total, low, high): number of values and both outer quartiles, as bucket edges."""
    whole = Window.partitionBy(*keys, "statistic")
    ranked = sketches.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("total", F.sum("n").over(whole))
    return ranked.groupBy(*keys, "statistic").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("low"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("high"),
    )


def cutoffs(rows: DataFrame) -> DataFrame:
    """A row per language and source of rows(lang_key, source_key, counts): least and greatest value of each statistic.

    A group with fewer than ``MIN_GROUP`` documents takes the cutoffs of the merged sketches of its language, and where
    these are small too, those of all documents.
    """
    fine = stage(sketch(rows, ["lang_key", "source_key"]), "rules-sketches")
    levels = [
        quartiles(merge(fine, keys) if len(keys) < 2 else fine, keys).withColumnsRenamed({c: f"{c}{i}" for c in ("total", "low", "high")})
        for i, keys in enumerate((["lang_key", "source_key"], ["lang_key"], []))
    ]
    joined = levels[0].join(levels[1], ["lang_key", "statistic"]).join(levels[2], ["statistic"])
    own, wider = F.col("total0") >= MIN_GROUP, F.col("total1") >= MIN_GROUP
    low, high = (F.when(own, F.col(f"{c}0")).when(wider, F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in ("low", "high"))
    columns = []
    for name, (_, _, _, least, both) in STATISTICS.items():
        reach, mine = FENCE * F.greatest(high - low, F.lit(least)), F.col("statistic") == name
        columns.append(F.max(F.when(mine, high + reach)).alias(f"max_{name}"))
        if both:
            columns.append(F.max(F.when(mine, low - reach)).alias(f"min_{name}"))
    return stage(joined.groupBy("lang_key", "source_key").agg(*columns), "rules-cutoffs")


def _judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` and ``kept`` to counted rows.

    The cutoffs are broadcast where they are few; beyond that they are shuffled, with each group's documents dealt to ``SALTS``
    parts and its cutoffs copied to all of them, so that no group is in one task.
    """
    keys = ["lang_key", "source_key"]
    if limits.count() <= MAX_BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(limits), keys, "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(*_COUNTS, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        copies = limits.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = salted.join(copies, [*keys, "salt"], "left").drop("salt")
    broken = []
    for name, (*_, both) in STATISTICS.items():
        value = _statistic(name)
        outside = value > F.col(f"max_{name}")
        broken.append(F.when(outside | (value < F.col(f"min_{name}")) if both else outside, F.lit(name)))
    joined = joined.withColumn("base_failed", base_failed())
    joined = joined.withColumn("failed_rules", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.concat_ws(",", *broken)))
    return joined.withColumn("kept", F.col("failed_rules") == "").drop(*[c for c in limits.columns if c not in keys])


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules) of every row.

    Words are runs of other than ASCII blanks, as written. A text fails the base rules with fewer than ``MIN_WORDS`` words or
    more than half its words in repeated windows of three. Of those that pass, sketches per language and source give the
    quartiles of the share of symbols, of repeated lines and words, and of the word length; a value further than ``FENCE`` distances
    between the quartiles (each with a least distance) beyond them fails. A null text has no words; a null
    language or source is a group of its own. Repeated rows count and are judged each.
    """
    rows = stage(counted(docs.select(F.col("doc_id").cast("long"), "lang", "source", "text")), "rules-counts")
    return _judged(rows, cutoffs(rows)).select("doc_id", *_COUNTS[:-1], "base_failed", "kept", "failed_rules")


def keep_passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with. Texts are counted twice rather than stored."""
    rows = counted(docs.select("lang", "source", "text", F.struct("*").alias("row")))
    return _judged(rows, cutoffs(rows.drop("row"))).filter("kept").select("row.*")
