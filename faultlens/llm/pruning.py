"""Leaving out rows before a shuffle, by a bitmap of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITMAP_BITS = 2**26  # 8 MB, the same at every size


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)) + 1


def perhaps_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose long ``key`` hashes to a bit that an id of ``ids`` (one long column) sets; null keys are left out.

    None that is among the ids is lost, so a join on the key may follow and gives the same rows; what it shuffles is less.
    The bitmap is broadcast in slices of 4 KB, ``BITMAP_BITS`` bits in all whatever the number of ids. The more
    ids, the less it leaves out: with as many ids as bits, a third of the other rows.
    """
    place = _place(ids.columns[0])
    bits = ids.filter(F.col(ids.columns[0]).isNotNull()).select(
        F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")
    )
    bitmap = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    bit = F.bitmap_bit_position(_place(key))
    byte = F.conv(F.hex(F.substring("_bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = rows.withColumn("_bucket", F.bitmap_bucket_number(_place(key))).join(F.broadcast(bitmap), "_bucket")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    return asked.filter(is_set).drop("_bucket", "_bitmap")
