"""Given tables, and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def count_words(text: Column) -> Column:
    """Number of words between blanks (space and the five ASCII control blanks); 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


def hash32(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the parts joined by ':' (null as empty text); the same number in any engine."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def smallest_hashes(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The ``n`` rows of smallest hash of the columns (ties by the columns), without every task sending ``n`` rows.

    Only rows below a bound that some 4 ``n`` of them are expected under are sorted; where it leaves too few, as
    with columns that repeat very often, it is raised.
    """
    h = F.xxhash64(*columns)
    share, some = 4 * n / max(1, rows.count()), rows
    while share < 1:
        some = rows.filter(h < int(share * 2**64) - 2**63)
        if some.select(columns[0]).limit(n).count() >= n:
            break
        share, some = 8 * share, rows
    return some.orderBy(h, *columns).limit(n)
