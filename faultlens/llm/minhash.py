"""Near duplicates by a MinHash LSH forest: sorted signature orders, neighbours by common prefix, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from faultlens.llm.components import components
from faultlens.llm.pruning import perhaps_among
from faultlens.llm.textops import blobs, hashed, mix, rolling, slices
from faultlens.sources.stage import stage

VALUES = 128
ORDERS = 32
SHARE = 0.44  # a region is as deep as pairs at the threshold still share it in this part of the orders
BITS = 2048  # of a set's sketch
LIKELIEST = 3  # neighbours of a document that are compared first
BLOCK = 256  # rows of sorted regions that are compared at once
_SLICE = 1_000_000
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)
_TURNS = np.array([_RNG.permutation(VALUES) for _ in range(ORDERS)])


def region_depth(percent: int) -> int:
    """Number of leading values that the documents of a region share."""
    return max(1, min(VALUES - 2, int(np.log(SHARE) / np.log(percent / 100)))) if percent < 100 else 16


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles (64-bit hashes) of each whole text; fewer words make one shingle, none no set."""
    h, bounds = hashed(texts)
    rolled = rolling(h, k)
    out = []
    for start, end in zip(bounds, bounds[1:]):
        if end - start >= k:
            out.append(np.unique(rolled[start:end - k + 1]))
        elif end > start:
            out.append(rolling(h[start:end], int(end - start)) ^ np.uint64(end - start))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set (none empty): 16 bits of its smallest value under each of ``VALUES`` hash functions, and its sketch,
    the bits that its members hash to."""
    joined = mix(np.concatenate(sets))
    sizes = [len(s) for s in sets]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), VALUES), np.uint16)
    for j, factor in enumerate(_FACTORS):
        out[:, j] = np.minimum.reduceat(joined * factor, starts) >> np.uint64(32) & np.uint64(0xFFFF)
    bits = np.zeros((len(sets), BITS), bool)
    bits[np.repeat(np.arange(len(sets)), sizes), (joined >> np.uint64(50)) % np.uint64(BITS)] = True
    return out, np.packbits(bits, axis=1)


def most_alike(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the Jaccard similarity of all rows of x with all of y: sketches as 0/1 floats, set sizes n and m.

    A bit that only one sketch has stands for a member that the other set lacks. The bound is never too low.
    """
    both = x @ y.T
    common = np.minimum((n - x.sum(axis=1))[:, None] + both, (m - y.sum(axis=1))[None, :] + both)
    return common / np.maximum(n[:, None] + m[None, :] - common, 1)


def _bits(packed: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1).astype(np.float32)


_SIGNED = "doc long, n long, set_key binary, signature binary, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = blobs(batch.column("text"))
        for start, end in slices(map(len, texts), _SLICE):
            sets = shingle_sets(texts[start:end], k)
            full = [i for i, s in enumerate(sets) if len(s)]
            key, sig, sketch = ([None] * len(sets) for _ in range(3))
            signed, bits = signatures([sets[i] for i in full]) if full else ((), ())
            for i, values, sketched in zip(full, signed, bits):
                key[i], sig[i], sketch[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), values.tobytes(), sketched.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()),
                 *(pa.array(x, pa.binary()) for x in (key, sig, sketch))],
                names=["doc", "n", "set_key", "signature", "sketch"],
            )


def _orders(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """A row per sorted order: region (its first ``depth`` values), then the next values to sort by."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        wide = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, VALUES).astype(np.uint64)
        for number, turn in enumerate(_TURNS):
            region = np.full(n, number, np.uint64)
            for j in turn[:depth]:
                region = mix(region * np.uint64(0x9E3779B97F4A7C15) + wide[:, j])
            rest = (wide[:, turn[depth]] << np.uint64(16)) | wide[:, turn[depth + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(region.view(np.int64)), pa.array(rest.astype(np.int64)), batch.column("doc"), batch.column("n")],
                names=["region", "rest", "doc", "n"],
            )


def _members(region, doc, n, before, size, joined, shared) -> pa.RecordBatch:
    alone = ~joined[shared]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x[shared]) for x in (region, doc, n)), *(pa.array(x[shared], pa.int64(), mask=alone) for x in (before, size))],
        names=["region", "doc", "n", "before", "size"],
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of regions with company, each with the row before it; rows at the ends of a task's run always stay."""
    last = None  # the last row waits for its successor
    for batch in batches:
        if not batch.num_rows:
            continue
        region, doc, n = (batch.column(c).to_numpy() for c in ("region", "doc", "n"))
        before, size = (np.concatenate([[-1], x[:-1]]) for x in (doc, n))
        joined = np.concatenate([[False], region[1:] == region[:-1]])
        shared = joined.copy()
        shared[:-1] |= joined[1:]
        if last is None:
            shared[0] = True
        else:
            if last[0] == region[0]:
                before[0], size[0], joined[0], shared[0], last[6] = last[1], last[2], True, True, True
            yield _members(*[np.array([x]) for x in last])
        columns = (region, doc, n, before, size, joined, shared)
        yield _members(*[x[:-1] for x in columns])
        last = [x[-1] for x in columns]
    if last is not None:
        last[6] = True
        yield _members(*[np.array([x]) for x in last])


def _rate(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bound reaches the threshold, with the bound."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(float) for c in "nm")
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in "xy")
        count = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        common = np.minimum(n - count(x & ~y), m - count(y & ~x))
        alike = common / np.maximum(n + m - common, 1)
        kept = 100 * alike >= percent - 1e-6
        yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(c).to_numpy()[kept]) for c in "ab"), pa.array(alike[kept])], names=["a", "b", "alike"])


class _Block:
    """Consecutive rows of the sorted regions."""

    def __init__(self, region, doc, component, n, sketch):
        self.region, self.doc, self.component, self.n = (np.asarray(x, np.int64) for x in (region, doc, component, n))
        self.sketch = sketch
        self.bits = _bits(sketch)


def _across(a: _Block, b: _Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one region and different components whose bound reaches the threshold."""
    fit = (a.region[:, None] == b.region[None, :]) & (a.component[:, None] != b.component[None, :])
    if not fit.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fit &= 100 * most_alike(a.bits, a.n, b.bits, b.n) >= percent - 1e-3
    i, j = np.nonzero(fit)
    return np.minimum(a.doc[i], b.doc[j]), np.maximum(a.doc[i], b.doc[j])


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64()), ("region", pa.int64()), ("rows", pa.binary())])


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Compares within blocks of ``BLOCK`` rows or so, cut between regions; where a region is longer than a block or may go
    on in another task, its blocks are returned too, to meet each other."""
    part, number = TaskContext.get().partitionId() << 32, 0
    rows: list[tuple] = []

    def done(open_start: bool, open_end: bool) -> Iterator[pa.RecordBatch]:
        block = _Block(*zip(*rows))
        a, b = _across(block, block, percent)
        a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.binary())], schema=_FOUND)
        edges = ({int(block.region[0])} if open_start else set()) | ({int(block.region[-1])} if open_end else set())
        for region in edges:
            at = np.flatnonzero(block.region == region)
            body = np.stack([block.doc[at], block.component[at], block.n[at]]).tobytes() + b"".join(block.sketch[i] for i in at)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([part + number]), pa.array([region]), pa.array([body], pa.binary())], schema=_FOUND)

    open_start = True
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("region", "doc", "component", "n", "sketch"))):
            new = bool(rows) and row[0] != rows[-1][0]
            if rows and (len(rows) >= BLOCK and new or len(rows) >= 2 * BLOCK):
                yield from done(open_start, not new)
                open_start, number, rows = not new, number + 1, []
            rows.append(row)
    if rows:
        yield from done(open_start, True)


def _unpacked(region: int, body: bytes) -> _Block:
    n = len(body) // (24 + BITS // 8)
    doc, component, size = np.frombuffer(body, np.int64, 3 * n).reshape(3, n)
    sketch = [body[24 * n + i * BITS // 8:24 * n + (i + 1) * BITS // 8] for i in range(n)]
    return _Block([region] * n, doc, component, size, sketch)


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            region = batch.column("region")[i].as_py()
            a, b = _across(_unpacked(region, batch.column("rows")[i].as_py()), _unpacked(region, batch.column("others")[i].as_py()), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    left = perhaps_among(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a", pairs.select("a"))
    right = perhaps_among(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b", pairs.select("b"))

    def check(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[ok]) for c in "ab"], names=["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of the documents.

    Documents are linked where 100 * common shingles >= percent * all shingles of both; component_id is the smallest
    id that links reach. Texts without words (null, empty) link with nothing; equal sets are one class
    with the smallest id as its representative, so copies are never paired. A row with a null id has a null
    component, is kept, and links nothing. Rows with equal ids are one document; of different texts under one id, that of
    the smallest set key is compared.

    Each of the ``ORDERS`` sorted orders takes other values of the signature first; rows that share its first values
    (``region_depth``) form a region, and within it rows are sorted by the next values, so that neighbours have the
    longest common prefixes. First every document is compared with the ``LIKELIEST`` of its neighbours. What these
    links join needs no further comparison: after that, only pairs of one region that lie in different components
    count. They are looked at in blocks of sorted rows, by an upper bound of their similarity from sketches of the whole
    sets; only pairs whose bound reaches the threshold become rows and are compared in full. So a region of very
    many copies costs a few pairs per copy, yet no link that would join components is left out. Regions are
    range-partitioned, so a large one is dealt to many tasks. The chance that a link at the threshold
    shares no region is below 1e-5.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    signed = stage(texts.mapInArrow(lambda b: _sign(b, shingle), _SIGNED), "signed")
    classes = stage(
        signed.filter("set_key IS NOT NULL AND doc IS NOT NULL").groupBy("set_key").agg(F.min("doc").alias("rep")), "classes"
    )
    links = _links(texts, signed, classes, shingle, percent)
    found = stage(components(links).select(F.col("node").alias("rep"), "component"), "found")
    plain = signed.select("doc", "n", "set_key")
    return (
        plain.join(classes, "set_key", "left")
        .join(found, "rep", "left")
        .select(
            F.col("doc").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _links(texts: DataFrame, signed: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between representatives that join all linked classes."""
    one = classes.groupBy(F.col("rep").alias("doc")).agg(F.min("set_key").alias("set_key"))
    reps = signed.join(one, ["set_key", "doc"]).groupBy("doc", "set_key")
    reps = stage(reps.agg(*[F.min(c).alias(c) for c in ("n", "signature", "sketch")]), "reps")
    spark, depth = texts.sparkSession, region_depth(percent)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = reps.select("doc", "n", "signature").mapInArrow(lambda b: _orders(b, depth), "region long, rest long, doc long, n long")
    in_order = orders.repartitionByRange(parts, "region", "rest", "doc").sortWithinPartitions("region", "rest", "doc")
    members = stage(in_order.mapInArrow(_neighbours, "region long, doc long, n long, before long, size long"), "members")

    close = F.least("n", "size") * 100 >= F.greatest("n", "size") * percent
    beside = members.filter(F.col("before").isNotNull() & close)
    beside = stage(beside.select(F.col("doc").alias("a"), F.col("before").alias("b"), "n", F.col("size").alias("m")).distinct(), "beside")
    sketches = reps.select("doc", "sketch")
    rated = (
        beside.join(perhaps_among(sketches.toDF("a", "x"), "a", beside.select("a")), "a")
        .join(perhaps_among(sketches.toDF("b", "y"), "b", beside.select("b")), "b")
        .mapInArrow(lambda batches: _rate(batches, percent), "a long, b long, alike double")
    )
    # a document has a neighbour per order at most, so these windows are small
    best = Window.partitionBy("a").orderBy(F.desc("alike"), "b")
    likeliest = stage(rated.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LIKELIEST).select("a", "b"), "likeliest")

    # sets of the documents that have company of a fitting size
    wanted = stage(members.select("doc").distinct().join(reps.select("doc", "set_key"), "doc"), "wanted")

    def pack(batches):
        for batch in batches:
            blob = blobs(batch.column("text"))
            for start, end in slices(map(len, blob), _SLICE):
                sets = [s.tobytes() for s in shingle_sets(blob[start:end], shingle)]
                same = [xxhash.xxh3_128_digest(s) == key for s, key in zip(sets, batch.column("set_key").to_pylist()[start:end])]
                kept = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(start, end - start).filter(kept), pa.array(sets, pa.binary()).filter(kept)], names=["doc", "shingles"]
                )

    # by a merge join at every size: the ids grow with the documents, so they are no side to broadcast
    asked = perhaps_among(texts, "doc", wanted.select("doc"))
    sets = stage(asked.join(wanted.hint("merge"), "doc").mapInArrow(pack, "doc long, shingles binary"), "sets")

    first = stage(_confirm(likeliest, sets, percent), "links")
    joined = components(first).select(F.col("node").alias("doc"), "component")
    placed = members.select("region", "doc", "n").join(joined, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = stage(placed, "placed")
    mixed = placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = stage(mixed.filter("low < high").select("region"), "mixed")
    placed = stage(placed.join(mixed, "region"), "placed-mixed")
    placed = placed.join(perhaps_among(sketches, "doc", placed.select("doc")), "doc")
    ordered = placed.repartitionByRange(parts, "region", "doc").sortWithinPartitions("region", "doc")
    found = ordered.mapInArrow(lambda b: _compare(b, percent), "a long, b long, block long, region long, rows binary")
    found = stage(found, "compared")
    blocks = found.filter("block IS NOT NULL").select("region", "block", "rows")
    others = blocks.select("region", F.col("block").alias("other"), F.col("rows").alias("others"))
    met = blocks.join(others, "region").filter("block < other").select("region", "rows", "others")
    met = met.mapInArrow(lambda b: _meet(b, percent), "a long, b long")
    across = stage(found.filter("a IS NOT NULL").select("a", "b").unionByName(met).distinct(), "across")
    rest = stage(_confirm(across, sets, percent), "links-across")
    return first.unionByName(rest)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that of the smallest id (of different texts under it, of the smallest hash), once if its row
    repeats. Rows are told apart by id and text, so different texts under one id are compared each; rows with null ids stay."""
    row, named = F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), docs.filter("doc_id IS NOT NULL")
    found = near_duplicates(named.select(row.alias("doc_id"), "text"), shingle, percent).select(F.col("doc_id").alias("_row"), "component_id")
    ids = named.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_id")).distinct()
    first = found.distinct().join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("_id", "_row")).alias("first"))
    kept = stage(first.select(F.col("first._row").alias("_kept")), "kept")
    left = named.withColumn("_row", row).join(kept, F.col("_row") == F.col("_kept"), "left_semi")
    return left.dropDuplicates(["_row"]).drop("_row").unionByName(docs.filter("doc_id IS NULL"))
