"""Embedding near-duplicates: epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from faultlens.llm.components import components
from faultlens.llm.tables import smallest_hashes
from faultlens.sources.stage import stage

THRESHOLD = 0.98
AXES = 6
BLOCK = 512
LEAF = 64
SAMPLE = 20_000
_SLACK = 1e-9


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors; None for null, empty, zero, or with a component that is null or not finite."""
    out = []
    for v in column.to_pylist():
        unit = None
        if v and all(x is not None for x in v):
            raw = np.array(v, float)
            if np.isfinite(raw).all() and raw.any():
                raw = raw / np.abs(raw).max()
                unit = raw / np.sqrt(raw @ raw)
        out.append(unit)
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = _vectors(batch.column("embedding"))
        kept = [i for i, u in enumerate(units) if u is not None]
        rows = batch.select(["id", "label"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array([len(units[i]) for i in kept], pa.int32()), pa.array([units[i].tobytes() for i in kept], pa.binary())],
            names=["id", "label", "dim", "unit"],
        )


def principal_axes(units: DataFrame, sample: int = SAMPLE, axes: int = AXES) -> dict[int, np.ndarray]:
    """Leading principal axes for each length of vector, from at most ``sample`` vectors (those of smallest hash).

    Any orthonormal axes give the same links; the sample only decides how much is skipped.
    """
    rows = smallest_hashes(units.select("dim", "unit"), ["unit"], sample).collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        x = np.array([np.frombuffer(r["unit"]) for r in rows if r["dim"] == dim])
        _, _, turned = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        out[dim] = turned[:axes]
    return out


def _project(batches: Iterator[pa.RecordBatch], found: dict[int, np.ndarray], cell: float, axes: int) -> Iterator[pa.RecordBatch]:
    """Adds the place on the leading axes (missing axes: 0) and the grid cells."""
    for batch in batches:
        place = np.zeros((batch.num_rows, axes))
        dims = batch.column("dim").to_numpy()
        raw = batch.column("unit").to_pylist()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            turned = found.get(int(dim), np.eye(min(axes, dim), dim))
            place[at, : len(turned)] = np.array([np.frombuffer(raw[i]) for i in at]) @ turned.T
        cells = np.floor(place / cell).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(list(place), pa.list_(pa.float64())), *(pa.array(cells[:, j]) for j in range(axes))],
            names=[*batch.schema.names, "place", *(f"c{j}" for j in range(axes))],
        )


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Packs the sorted rows into blocks of one label and length, ``size`` rows at most."""
    part, number = TaskContext.get().partitionId(), 0
    key, ids, units, places = None, [], [], []

    def block() -> pa.RecordBatch:
        place = np.array(places)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + number], pa.int64()), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()),
                pa.array([place.min(axis=0)], pa.list_(pa.float64())), pa.array([place.max(axis=0)], pa.list_(pa.float64())),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(units)], pa.binary()),
                pa.array([place.tobytes()], pa.binary()),
            ],
            names=["block", "label", "dim", "low", "high", "ids", "units", "places"],
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("label", "dim", "id", "unit", "place"))
        for label, dim, row, unit, place in zip(*columns):
            if ids and (len(ids) == size or key != (label, dim)):
                yield block()
                number, ids, units, places = number + 1, [], [], []
            key = (label, dim)
            ids.append(row), units.append(unit), places.append(place)
    if ids:
        yield block()


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap)


class _Sequence:
    """A block's vectors in grid order, with the bounds of any interval of them."""

    def __init__(self, ids: bytes, units: bytes, places: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.units = np.frombuffer(units).reshape(len(self.ids), -1)
        self.places = np.frombuffer(places).reshape(len(self.ids), -1)
        self._bounds: dict[tuple[int, int], tuple] = {}

    def bounds(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if (start, end) not in self._bounds:
            part = self.places[start:end]
            self._bounds[start, end] = part.min(axis=0), part.max(axis=0)
        return self._bounds[start, end]


def _halves(start: int, end: int) -> list[tuple[int, int]]:
    if end - start <= LEAF:
        return [(start, end)]
    mid = (start + end) // 2
    return [(start, mid), (mid, end)]


def join_sequences(a: _Sequence, b: _Sequence, same: bool, threshold: float, square: float):
    """Joins two sequences by halving both; interval pairs over epsilon apart are left out.

    Returns the links of each vector of a and of b, and links (positions; those of b follow a's) that connect what
    all links connect: within a pair of leaves a forest, not all pairs.
    """
    links_a, links_b, forest = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64), []
    shift = 0 if same else len(a.ids)
    todo = [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k < i or _apart(*a.bounds(i, j), *b.bounds(k, m)) > square:
            continue
        if j - i > LEAF or m - k > LEAF:
            todo += [(*x, *y) for x in _halves(i, j) for y in _halves(k, m)]
            continue
        hit = a.units[i:j] @ b.units[k:m].T >= threshold
        alone = same and i == k
        if hit.any():  # rows of one id are one vector: no links between them
            hit &= a.ids[i:j, None] != b.ids[None, k:m]
        if not hit.any():
            continue
        links_a[i:j] += hit.sum(axis=1)
        if not alone:
            links_b[k:m] += hit.sum(axis=0)
        forest += _forest(hit, i, shift + k)
    return links_a, links_b, forest


def _forest(hit: np.ndarray, row: int, column: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the bipartite graph in ``hit``: rows hang on their first column, columns on a row."""
    rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    mark = np.arange(hit.shape[0])
    while True:  # smallest row that reaches each row
        by_column = np.where(hit, mark[:, None], hit.shape[0]).min(axis=0)
        new = np.minimum(mark, np.where(hit, by_column[None, :], hit.shape[0]).min(axis=1))
        if (new == mark).all():
            break
        mark = new
    first = hit.argmax(axis=0)
    out = [(row + int(first[c]), column + int(c)) for c in columns]
    return out + [(row + int(mark[r]), row + int(r)) for r in rows if mark[r] != r]


def _join_pairs(batches: Iterator[pa.RecordBatch], threshold: float, square: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
            same = get("block_a") == get("block_b")
            a = _Sequence(get("ids_a"), get("units_a"), get("places_a"))
            b = a if same else _Sequence(get("ids_b"), get("units_b"), get("places_b"))
            links_a, links_b, forest = join_sequences(a, b, same, threshold, square)
            if same:
                ids, n = a.ids, links_a + links_b
            else:
                ids, n = np.concatenate([a.ids, b.ids]), np.concatenate([links_a, links_b])
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(n[some])], schema=schema)
            if forest:
                ends = ids[np.array(sorted(set(forest)))]
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.nulls(len(ends), pa.int64())], schema=schema)


def _box_gap(axes: int) -> Column:
    gaps = [F.greatest(F.lit(0.0), F.col("low")[j] - F.col("high_b")[j], F.col("low_b")[j] - F.col("high")[j]) for j in range(axes)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def similar_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, axes: int = AXES, sample: int = SAMPLE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors(vec_id, embedding, label).

    Vectors of one label (not null) and length are linked if their cosine in double precision is at least
    ``threshold``. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing,
    nor do rows with a null id (their component is null, and they are kept). Links of rows that share an id are
    added up, and there are none between them; exactly repeated rows count once.

    Unit vectors with cosine >= t lie within epsilon = sqrt(2 - 2 t). They are sorted by grid cells of side epsilon
    on the leading principal axes and range-partitioned in that order (a crowded cell is dealt to many tasks), then
    cut into blocks of at most ``block`` rows. Blocks meet through the cells of two axes that they reach, and only
    if their bounds are within epsilon; each pair of blocks is joined by halving both sequences, leaving out
    intervals that are provably apart. A pair of blocks yields link counts and a forest of links, never all pairs.
    """
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    usable = rows.filter("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").distinct()
    units = stage(usable.mapInArrow(_units, "id long, label long, dim int, unit binary"), "units")
    found = principal_axes(units, sample, axes)
    names = [f"c{j}" for j in range(axes)]
    placed = units.mapInArrow(
        lambda b: _project(b, found, epsilon, axes),
        "id long, label long, dim int, unit binary, place array<double>, " + ", ".join(f"{c} int" for c in names),
    )
    placed, order = stage(placed, "placed"), ["label", "dim", *names, "id"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = sorted_rows.mapInArrow(
        partial(_cut, size=block),
        "block long, label long, dim int, low array<double>, high array<double>, ids binary, units binary, places binary",
    )
    blocks = stage(blocks, "blocks")

    cells = lambda axis, less, more: F.sequence(
        (F.floor(F.col("low")[axis] / epsilon) - less).cast("int"), (F.floor(F.col("high")[axis] / epsilon) + more).cast("int")
    )
    bounds = blocks.select("block", "label", "dim", "low", "high")
    second = 1 if axes > 1 else 0
    reach = lambda more: (
        bounds.withColumn("x", F.explode(cells(0, more, more))).withColumn("y", F.explode(cells(second, more, more)))
    )
    near = reach(1).select("label", "dim", "x", "y", F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    pairs = (
        reach(0).join(near, ["label", "dim", "x", "y"])
        .filter((F.col("block") <= F.col("block_b")) & (_box_gap(axes) <= epsilon**2))
        .select(F.col("block").alias("block_a"), "block_b").distinct()
    )
    pairs = stage(pairs, "block-pairs")
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "units", "places")])
    both = pairs.join(side("a"), "block_a").join(side("b"), "block_b")
    out = stage(both.mapInArrow(partial(_join_pairs, threshold=threshold, square=epsilon**2), "a long, b long, n long"), "links")
    counts = stage(out.filter("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links")), "counts")
    joined = stage(components(out.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id"), "components")
    return (
        rows.select("id").join(counts, "id", "left").join(joined, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
