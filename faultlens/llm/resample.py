"""Importance resampling towards a target: hashed n-gram weights, exact cutoff by weighted medians of medians."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultlens.llm.textops import blobs, slices
from faultlens.sources.stage import stage

BUCKETS = 10_000
ORDERS = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
FEW_KEYS = 2_000  # so many keys are sorted at once when the search has come down to them
_RESTAGE = 8  # keys still in question are written anew when only one in so many is left
_KEY = ("k_score", "k_id", "k_n", "k_row")
_LAST_ID = 2**63 - 1
_SHORT = 64

# bytes that are part of a word: 0-9, a-z (A-Z lower-cased) and all above ASCII; the others part words
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(blob: bytes) -> list[bytes]:
    return blob.translate(_FOLDED).split()


def _append_zero(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(8)) ^ table[crc & np.uint32(255)]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What appending n bytes does to a checksum, for each of its four bytes and 256 values.

    The checksum of two strings is that of the first, shifted by the length of the second, xor that of the second.
    First all n below ``_SHORT``, then powers of two.
    """
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    short = np.empty((_SHORT, 4, 256), np.uint32)
    for n in range(_SHORT):
        short[n] = now
        now = _append_zero(now, table)
    powers = [short[1]]
    for _ in range(32):
        powers.append(_apply(powers[-1], powers[-1]))
    return short.reshape(-1), powers


def _apply(crc: np.ndarray, shift: np.ndarray) -> np.ndarray:
    out = shift[0][crc & np.uint32(255)]
    for j in (1, 2, 3):
        out = out ^ shift[j][(crc >> np.uint32(8 * j)) & np.uint32(255)]
    return out


_SHORT_TABLE, _POWERS = _shift_tables()


def join_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of concatenations, from those of both parts and the length of the second."""
    at = np.minimum(length, _SHORT - 1).astype(np.int32) << 10
    out = second.copy()
    for j in range(4):
        out ^= _SHORT_TABLE.take(at + (256 * j) + ((first >> np.uint32(8 * j)) & np.uint32(255)).astype(np.int32))
    far = np.flatnonzero(length >= _SHORT)
    if len(far):
        shifted, rest = first[far], length[far]
        for bit, power in enumerate(_POWERS):
            on = (rest >> bit) & 1 == 1
            shifted[on] = _apply(shifted[on], power)
        out[far] = shifted ^ second[far]
    return out


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``ORDERS`` words, the text of each, and the number of words of each text."""
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    ids = [np.array(list(map(index.__getitem__, split_words(t))), np.int64) for t in texts]
    n_words = np.array([len(i) for i in ids], np.int64)
    token = np.concatenate(ids) if ids else np.empty(0, np.int64)
    alone = np.fromiter(map(zlib.crc32, index), np.uint32, len(index))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in index), np.uint32, len(index))
    length = np.fromiter(map(len, index), np.int64, len(index)) + 1
    owner = np.repeat(np.arange(len(texts)), n_words)
    run = alone[token]
    crcs, owners = [run], [owner]
    for order in range(1, ORDERS):
        if len(token) <= order:
            break
        run = join_crc(run[:-1], spaced[token[order:]], length[token[order:]])
        inside = owner[order:] == owner[:-order]
        crcs.append(run[inside])
        owners.append(owner[order:][inside])
    return np.concatenate(crcs).astype(np.int64) % buckets, np.concatenate(owners), n_words


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        texts = blobs(batch.column("text"))
        for start, end in slices(map(len, texts)):
            total += np.bincount(features(texts[start:end], buckets)[0], minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket; every task sends one row per bucket at most."""
    counted = texts.select("text").mapInArrow(lambda b: _count(b, buckets), "bucket long, n long")
    out = [0] * buckets
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of target and raw shares of each bucket, with one added to every count."""
    n, s, t = len(raw), sum(raw), sum(target)
    return np.array(
        [math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(raw, target)], np.int64
    )


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def rate(batches):
        for batch in batches:
            texts, parts = blobs(batch.column("text")), []
            for start, end in slices(map(len, texts)):
                bucket, owner, n_words = features(texts[start:end], len(shared.value))
                weight = np.bincount(owner, weights=shared.value[bucket], minlength=end - start).astype(np.int64)
                parts.append((np.bincount(owner, minlength=end - start), n_words, weight))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in columns)], names=["doc_id", "n_features", "n_words", "weight"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, n_features long, n_words long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that follows from the id alone (a null id is empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _key_of(values: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(int(v)).cast("long").alias(name) for name, v in zip(_KEY, values)])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's keys up to the pivot and of those after it: the lower median and the number."""
    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    left = table.column("left").to_numpy()
    keys = np.stack([table.column(c).to_numpy() for c in _KEY])
    for side in (True, False):
        mine = keys[:, left == side]
        if mine.shape[1]:
            middle = np.lexsort(mine[::-1])[(mine.shape[1] - 1) // 2]
            row = [side, mine.shape[1], *map(int, mine[:, middle])]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["left", "n", *_KEY])


def cutoff(keys: DataFrame, n: int, few: int = FEW_KEYS) -> tuple[int, ...] | None:
    """The ``n``-th smallest of the keys (four long columns named as ``_KEY``, all rows different), None if n < 1.

    Every round reads the keys in question once: each partition gives the medians of its keys before and after the pivot,
    the driver takes the median of those on the side that holds the cutoff, weighted by their numbers of keys, as the next
    pivot. At least a quarter of the keys goes in a round. The driver sees two rows per partition.
    """
    if n < 1:
        return None
    here = F.struct(*_KEY)
    low = high = pivot = None
    staged, n_staged = keys.select(*_KEY), None
    while True:
        rows = staged
        if low is not None:
            rows = rows.filter(here > _key_of(low))
        if high is not None:
            rows = rows.filter(here <= _key_of(high))
        side = F.lit(False) if pivot is None else here <= _key_of(pivot)
        found = rows.withColumn("left", side).mapInArrow(_medians, "left boolean, n long, " + ", ".join(f"{c} long" for c in _KEY)).collect()
        before = sum(r["n"] for r in found if r["left"])
        if pivot is not None and before == n:
            return pivot
        if pivot is not None and before > n:
            high, inside = pivot, [r for r in found if r["left"]]
        else:
            low, n, inside = pivot if pivot is not None else low, n - before, [r for r in found if not r["left"]]
        left = sum(r["n"] for r in inside)
        if n > left:
            raise ValueError("more rows asked for than there are")
        pivot, upto = None, 0
        for r in sorted(inside, key=lambda r: tuple(r[c] for c in _KEY)):
            pivot, upto = tuple(r[c] for c in _KEY), upto + r["n"]
            if 2 * upto >= left:
                break
        n_staged = n_staged or left
        if left <= few or left * _RESTAGE <= n_staged:
            rest = staged
            if low is not None:
                rest = rest.filter(here > _key_of(low))
            if high is not None:
                rest = rest.filter(here <= _key_of(high))
            if left <= few:
                return sorted(tuple(r) for r in rest.collect())[n - 1]
            staged, n_staged = stage(rest, "resample-keys"), left


def _ranked(drawn: DataFrame) -> DataFrame:
    """Adds ``rank``: rows are sorted by ranges of the key; only the sizes of the ranges reach the driver."""
    sorted_rows = drawn.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(sorted_rows, "resample-drawn").withColumn("_part", F.shiftright("_at", 33))
    offsets, total = [], 0
    for row in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets.append((row["_part"], total))
        total += row["n"]
    starts = drawn.sparkSession.createDataFrame(offsets, "_part long, _start long")
    placed = placed.join(F.broadcast(starts), "_part")  # a row per range
    return placed.withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_part", "_start", "_at")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED,
    few: int = FEW_KEYS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words), a row for each row of docs(doc_id, text).

    Features are runs of one to three words, hashed to buckets; a bucket gains by the ratio of its share in the
    texts of ``target`` to that in ``docs``. A weight is the sum of a text's gains, the score adds a variate that follows from seed and
    id. Of the rows with ``min_words`` words or more, ``percent`` of a hundred with the highest scores are drawn and ranked from 1;
    the others have no rank. Equal scores: smaller ids first, null ids last, then fewer features; of rows alike in all these,
    which are in the outcome alike too, each counts. Null and empty texts have no words, no features and weight 0; a
    target without words gives gains by the smoothing alone.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = weigh(docs, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = stage(
        rows.select(
            "*", (-F.col("score")).alias("k_score"), F.coalesce("doc_id", F.lit(_LAST_ID)).alias("k_id"),
            F.col("n_features").alias("k_n"), F.monotonically_increasing_id().alias("k_row"),
        ),
        "resample-scores",
    )
    eligible = F.col("n_words") >= min_words
    n = rows.filter(eligible).count() * percent // 100
    last = cutoff(rows.filter(eligible), n, few)
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(columns)
    drawn = eligible & (F.struct(*_KEY) <= _key_of(last))
    others = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return others.select(columns).unionByName(_ranked(rows.filter(drawn)).select(columns))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents drawn by ``resample``, whole rows; of a repeated id all rows, if one of them is drawn."""
    ids = resample(docs, target, **settings).filter("rank IS NOT NULL").select("doc_id").distinct()
    return docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
