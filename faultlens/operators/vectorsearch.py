"""Nearest articles by cosine similarity, exact and approximate.

Both sides are cut into blocks of bounded size; Spark shuffles block pairs together, a task holds the articles of its pair and
takes the queries batch by batch. A product in single precision leaves out what cannot be among the best k of a query;
the rest is scored in double precision. No block pair ever leaves its task, and neither side passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.sources.stage import stage

ARTICLE_BLOCK = 196_608  # articles that a task holds: 150 MB at 64 dimensions
QUERY_BLOCK = 262_144
CELL_ROWS = 2048
PROBED = 0.8  # share of the cells that a query visits
MAX_CELLS = 4096
SAMPLE = 20_000
_MARGIN = 1e-6  # rounding of angles
DIGITS = 6
_SLICE = 512
_PENDING = 1 << 12  # pairs scored at a time: soon, as what they give spares others
_TASKS = 3  # per core, where the rows are enough for that


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length; give dim")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(sizes), -1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=m, where=length > 0)


class _Block:
    """Articles of one block by cell, those of finite vectors; of equal vectors of a cell the k smallest ids.

    In a cell those nearest to the direction ``towards`` come first: queries of about that direction then find good hits soon, and fewer
    pairs after them are looked at again. The order changes no hit.
    """

    def __init__(self, ids: pa.Array, units: np.ndarray, cell: np.ndarray | None, k: int, width: int = CELL_ROWS, towards: np.ndarray | None = None):
        order = pc.sort_indices(ids).to_numpy()
        order = order[np.isfinite(units[order]).all(axis=1)]
        rows = np.ascontiguousarray(units[order])
        if len(rows) > k and rows.shape[1]:
            _, same = np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True)
            by_group = np.argsort(same, kind="stable")
            at = np.arange(len(same))
            first = np.maximum.accumulate(np.where(np.diff(same[by_group], prepend=-1) != 0, at, 0))
            kept = np.sort(by_group[at - first < k])
            order, rows = order[kept], rows[kept]
        cell = np.zeros(len(order), np.int64) if cell is None else cell[order]
        near = np.zeros(len(order)) if towards is None or not len(order) else rows @ towards
        self.place = np.lexsort((-near, cell))  # rank by id: ties go to the smaller
        self.ids, self.units, self.k = ids.take(pa.array(order[self.place])), rows[self.place], k
        self.narrow = self.units.astype(np.float32)
        ends = np.flatnonzero(np.diff(cell[self.place], append=-1))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.slices = [
            (int(cell[self.place[s]]), i, min(i + width, e + 1)) for s, e in zip(starts, ends) for i in range(s, e + 1, width)
        ]

    def best(self, units: np.ndarray, least: np.ndarray, visited: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, article, points) of the best k of each query, as positions; ``visited`` says which cells a query meets.

        ``least``: the k-th hit is known to be as similar as that (-inf: not known).
        """
        k, margin, scale = self.k, 2e-7 * (units.shape[1] + 64), 10**DIGITS  # margin: rounding in single precision and to DIGITS
        narrow, bar = units.astype(np.float32), (least - margin).astype(np.float32)
        found = (np.empty(0, np.int64),) * 3
        pending, held = [], 0
        room = np.empty(len(units) * max((end - start for _, start, end in self.slices), default=0), np.float32)  # one for all products: new memory costs as much as they do

        def settled():
            rows, cols = (np.concatenate(x) for x in zip(*pending))
            exact = [np.einsum("ij,ij->i", units[rows[i:i + _PENDING]], self.units[cols[i:i + _PENDING]]) for i in range(0, len(rows), _PENDING)]
            points = np.rint(np.concatenate(exact) * scale).astype(np.int64)
            rows, cols, points = (np.concatenate(x) for x in zip(found, (rows, cols, points)))
            order = np.lexsort((self.place[cols], -points, rows))
            at = np.arange(len(order))
            rank = at - np.maximum.accumulate(np.where(np.diff(rows[order], prepend=-1) != 0, at, 0))
            last = order[rank == k - 1]
            bar[rows[last]] = np.maximum(bar[rows[last]], (points[last] / scale - margin).astype(np.float32))
            return tuple(x[order[rank < k]] for x in (rows, cols, points))

        for cell, start, end in self.slices:
            who = np.arange(len(units)) if visited is None else np.flatnonzero(visited[:, cell])
            if not len(who):
                continue
            near = np.matmul(narrow if len(who) == len(units) else narrow[who], self.narrow[start:end].T, out=room[:len(who) * (end - start)].reshape(len(who), -1))
            bars = bar[who]
            fresh = np.isneginf(bars)
            if fresh.any() and end - start >= k:
                bars[fresh] = np.partition(near[fresh], -k, axis=1)[:, -k] - np.float32(margin)
                bar[who] = bars
            some = np.flatnonzero(near.max(axis=1) >= bars)  # few: all pairs are then looked at once only
            if not len(some):
                continue
            row, col = np.divmod(np.flatnonzero(near[some] >= bars[some, None]), end - start)
            pending.append((who[some[row]], col + start))
            held += len(row)
            if held > _PENDING:
                found, pending, held = settled(), [], 0
        return settled() if pending else found


def _meet(batches: Iterator[pa.RecordBatch], k: int, rule: Callable | None, width: int) -> Iterator[pa.RecordBatch]:
    """The best k articles of each query in its block pair. Rows are sorted by pair, the articles of a pair before its queries."""
    pair, parts, block = None, [], None
    for batch in batches:
        pairs, side = batch.column("pair").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero(np.diff(pairs * 2 + side)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(pairs)]):
            if start == end:
                continue
            run = batch.slice(start, end - start)
            if pairs[start] != pair:
                pair, parts, block = pairs[start], [], None
            if side[start] == 0:
                parts.append((run.column("id"), _matrix(run.column("vec")), run.column("cell").to_numpy()))
                continue
            if block is None:
                if not parts:
                    continue
                ids, units, cell = zip(*parts)
                parts = []
                asked = _matrix(run.column("vec"))
                towards = asked[np.isfinite(asked).all(axis=1)].sum(axis=0)
                block = _Block(pa.concat_arrays(ids), np.concatenate(units), np.concatenate(cell), k, width, towards)
                del ids, units, cell
            yield from _answered(block, run, rule)


def _answered(block: _Block, queries: pa.RecordBatch, rule: Callable | None) -> Iterator[pa.RecordBatch]:
    for start in range(0, queries.num_rows, _SLICE):
        part = queries.slice(start, _SLICE)
        units, least = _matrix(part.column("vec")), part.column("least").to_numpy()
        rows, cols, points = block.best(units, least, None if rule is None else rule(units, least))
        hits = [part.column("query_id").take(pa.array(rows)), block.ids.take(pa.array(cols)), pa.array(points / 10**DIGITS)]
        yield pa.RecordBatch.from_arrays(hits, names=["query_id", "id", "similarity"])


def _clean(df: DataFrame, key: str, vector: str, dim: int | None) -> DataFrame:
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0)
    if dim is not None:
        ok = ok & (F.size(vector) == dim)
    return df.filter(ok).select(F.col(key), F.col(vector).alias("vec"))


def _n_blocks(rows: int, block: int) -> int:
    return max(1, math.ceil(rows / block))


def _merge(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _part_of(key: str, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.xxhash64(key), n).cast("int")


def vector_topk(
    queries: DataFrame,
    articles: DataFrame,
    k: int = fv.TOP_K,
    vector: str = "embedding",
    dim: int | None = None,
    article_block: int = ARTICLE_BLOCK,
    query_block: int = QUERY_BLOCK,
    n_queries: int | None = None,
    n_articles: int | None = None,
) -> DataFrame:
    """Exact: queries(query_id, vector) x articles(id, vector) -> (query_id, id, similarity, rank).

    Vectors that are null, empty, not of length ``dim`` or not finite are no candidates. Similarities carry six
    digits; equal ones are ordered by id. Pass the row counts (or upper bounds) where they are known:
    counting a derived table here would compute it twice. Every pair is compared, so the time grows as queries times
    articles; what is shuffled grows as either side times the blocks of the other.
    """
    n_articles = articles.select("id").count() if n_articles is None else n_articles
    n_queries = queries.select("query_id").count() if n_queries is None else n_queries
    queries, articles = _clean(queries, "query_id", vector, dim), _clean(articles, "id", vector, dim)
    asked, homes = queries.withColumn("least", F.lit(float("-inf"))), articles.withColumn("cell", F.lit(0))
    return _merge(_met(asked, homes, *_layout(queries, n_queries, n_articles, article_block, query_block), k), k)


def _layout(queries: DataFrame, n_queries: int, n_articles: int, article_block: int = ARTICLE_BLOCK, query_block: int = QUERY_BLOCK) -> tuple[int, int]:
    """Blocks of queries and of articles: of bounded size, and pairs enough for the cores with the least rows shuffled."""
    most = [max(1, math.ceil(n / rows)) for n, rows in ((n_queries, _SLICE), (n_articles, CELL_ROWS))]
    tasks = _TASKS * queries.sparkSession.sparkContext.defaultParallelism
    n_article = max(math.ceil(n_articles / article_block), min(most[1], round(math.sqrt(tasks * n_articles / max(1, n_queries)))), 1)
    return max(math.ceil(n_queries / query_block), min(most[0], math.ceil(tasks / n_article)), 1), n_article


def _met(queries: DataFrame, articles: DataFrame, n_query: int, n_article: int, k: int, rule: Callable | None = None, width: int = CELL_ROWS) -> DataFrame:
    """Best k per query and block of articles: queries(query_id, vec, least) x articles(id, vec, cell).

    ``rule(units, least)`` is the mask of the cells that the queries visit; without it they visit all. A product has ``width`` articles of one cell at most.
    """
    key = queries.schema["query_id"].dataType.simpleString()
    kinds = {df.schema["vec"].dataType.simpleString() for df in (queries, articles)}
    vec = F.col("vec").cast("array<float>" if kinds == {"array<float>"} else "array<double>").alias("vec")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", _part_of("query_id", n_query).alias("q_at"), every(n_article).alias("a_at"))
    right = articles.select("*", _part_of("id", n_article).alias("a_at"), every(n_query).alias("q_at"))
    pair = (F.col("q_at") * n_article + F.col("a_at")).cast("int").alias("pair")
    left = left.select(pair, F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), vec, F.lit(0).alias("cell"), "query_id", "least")
    right = right.select(
        pair, F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), vec, "cell",
        F.lit(None).cast(key).alias("query_id"), F.lit(0.0).alias("least"),
    )
    together = left.unionByName(right).repartitionById(n_query * n_article, "pair").sortWithinPartitions("pair", "side")
    return together.mapInArrow(partial(_meet, k=k, rule=rule, width=width), f"query_id {key}, id long, similarity double")


def hyperplanes(n_bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng(20240101).standard_normal((n_bits, dim))


def _sides(units: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of vectors to the planes, and the cell that they lie in."""
    margins = units @ planes.T
    return margins, ((margins > 0) * (1 << np.arange(planes.shape[0]))).sum(axis=1)


def _cells(units: np.ndarray, planes: np.ndarray, n_probe: int) -> np.ndarray:
    """The home cell and those across the nearest planes."""
    margins, home = _sides(units, planes)
    nearest = np.argsort(np.abs(margins), axis=1, kind="stable")[:, : n_probe - 1]
    return np.concatenate([home[:, None], home[:, None] ^ (1 << np.arange(planes.shape[0]))[nearest]], axis=1)


def _nearest_cells(units: np.ndarray, planes: np.ndarray, n_probe: int) -> np.ndarray:
    """The home cell and those reached by crossing the planes of least summed squared margins; ties by cell."""
    margins, home = _sides(units, planes)
    cells = np.arange(1 << planes.shape[0])
    across = ((cells[:, None] & (1 << np.arange(planes.shape[0]))) > 0).astype(np.float64)
    return home[:, None] ^ np.argsort(margins**2 @ across.T, axis=1, kind="stable")[:, :n_probe]


def vector_topk_ann(
    queries: DataFrame,
    articles: DataFrame,
    k: int = fv.TOP_K,
    vector: str = "embedding",
    dim: int = 64,
    n_bits: int | None = None,
    n_probe: int | None = None,
    cell_rows: int = CELL_ROWS,
    n_queries: int | None = None,
    n_articles: int | None = None,
) -> DataFrame:
    """Approximate: articles live in cells cut by fixed hyperplanes, a query visits its own cell and the
    cells across its nearest planes. Scores of the hits are exact.

    Without ``n_probe`` a query visits the share ``PROBED`` of all cells, nearest first, so that recall does not fall with
    the number of cells. A given ``n_probe`` is the home cell and those across a single plane, n_bits + 1 at most.

    A task has a block of articles and works out the cells of the queries it takes, so no row per query and cell is written or
    shuffled; a product has ``cell_rows`` articles of one cell at most. Queries whose cells hold fewer than k articles are searched exactly, so none is
    short of k while there are candidates.
    """
    n_articles = articles.select("id").count() if n_articles is None else n_articles
    n_queries = queries.select("query_id").count() if n_queries is None else n_queries
    if n_bits is None:
        n_bits = max(1, math.ceil(math.log2(_n_blocks(n_articles, cell_rows))))
    queries, articles = _clean(queries, "query_id", vector, dim), _clean(articles, "id", vector, dim)
    planes = hyperplanes(n_bits, dim)
    probe = _nearest_cells if n_probe is None else _cells
    n_probe = math.ceil(PROBED * 2**n_bits) if n_probe is None else min(n_probe, n_bits + 1)

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        return pd.Series(_sides(_unit(vectors), planes)[1].astype(np.int32))

    def visited(units, least):
        mask = np.zeros((len(units), 1 << n_bits), bool)
        np.put_along_axis(mask, probe(units, planes, n_probe), True, axis=1)
        return mask

    asked, homes = queries.withColumn("least", F.lit(float("-inf"))), articles.withColumn("cell", home("vec"))
    found = stage(_merge(_met(asked, homes, *_layout(queries, n_queries, n_articles), k, visited, cell_rows), k), "cell-hits")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id")
    # ids alone are compared with all hits; there are few such queries, if any
    short_ids = stage(queries.select("query_id").join(full, "query_id", "left_anti").distinct().withColumnRenamed("query_id", "short_id"), "short-ids")
    if short_ids.isEmpty():
        return found
    short = stage(queries.join(short_ids, F.col("query_id").eqNullSafe(F.col("short_id")), "left_semi"), "short-queries")
    rest = vector_topk(short, articles, k, "vec", n_articles=n_articles)
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)


def learned_centres(articles: DataFrame, n_cells: int, n_articles: int, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centres of ``n_cells`` groups of directions at most, from ``sample`` of the articles(id, vec) at most, chosen by hash."""
    share = min(1.0, 1.2 * sample / max(1, n_articles))
    chosen = articles.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample).toPandas()
    units = _unit(chosen["vec"]) if len(chosen) else np.empty((0, 0))
    units = np.unique(np.round(units[(units * units).sum(axis=1) > 0], 9), axis=0)
    if not len(units):
        return units
    centres = units[np.random.default_rng(5).permutation(len(units))[:n_cells]]
    for _ in range(rounds):
        home = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """Groups of articles round learned centres: the largest angle to a member and the number of members of each.

    The last cell, without a centre, holds the vectors of length zero; they are similar to nothing.
    """

    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.centres.T, -1.0, 1.0)) if len(self.centres) else np.empty((len(units), 0))

    def home(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angles, zero = self.angles(units), (units * units).sum(axis=1) == 0
        if not len(self.centres):
            return np.zeros(len(units), np.int64), np.zeros(len(units))
        cell = np.where(zero, len(self.centres), angles.argmin(axis=1))
        return cell, np.where(zero, 0.0, angles.min(axis=1))

    def nearest(self, units: np.ndarray, k: int) -> np.ndarray:
        """Cells in order of their angle, as many as hold k members (all, where there are not so many), as a mask."""
        order = np.argsort(np.concatenate([self.angles(units), np.full((len(units), 1), 4.0)], axis=1), axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        mask = np.zeros(order.shape, bool)
        np.put_along_axis(mask, order, before < k, axis=1)
        return mask & (self.size > 0)

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """No member of the cell is more similar to the vector than this."""
        least = np.maximum(self.angles(units) - self.radius[:-1] - _MARGIN, 0.0)
        zero = (units * units).sum(axis=1) == 0
        return np.concatenate([np.where(zero[:, None], 0.0, np.cos(least)), np.zeros((len(units), 1))], axis=1)


def _settle(articles: DataFrame, n_cells: int, n_articles: int) -> tuple[DataFrame, Cells]:
    """Articles with their cell, and the cells."""
    centres = learned_centres(articles, n_cells, n_articles)
    empty = Cells(centres, np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64))

    @F.pandas_udf("cell int, angle double")
    def home(vectors: pd.Series) -> pd.DataFrame:
        cell, angle = empty.home(_unit(vectors))
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle})

    homes = stage(articles.withColumn("h", home("vec")).select("id", "vec", "h.cell", "h.angle"), "settled")
    radius, size = empty.radius.copy(), empty.size.copy()
    for row in homes.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        radius[row["cell"]], size[row["cell"]] = row["angle"], row["n"]
    return homes.drop("angle"), Cells(centres, radius, size)


def _compared(rule, size: np.ndarray):
    """Members of the cells that a query visits."""

    @F.pandas_udf("long")
    def compared(vectors: pd.Series, least: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(vectors), _SLICE):
            mask = rule(_unit(vectors.iloc[start:start + _SLICE]), least.iloc[start:start + _SLICE].to_numpy(dtype=np.float64))
            out.append(mask @ size)
        return pd.Series(np.concatenate(out) if out else [], dtype=np.int64)

    return compared("vec", "least").alias("n_compared")


def _bounded(queries, articles, k, vector, dim, n_cells, slack, cell_rows, n_queries, n_articles):
    """Hits, compared(query_id, n_compared) of both rounds, and the sizes of the cells.

    Which cells a query visits follows from its vector and the centres, so a task works it out for the queries it has: no row
    per query and cell is shuffled or written.
    """
    articles, queries = _clean(articles, "id", vector, dim), stage(_clean(queries, "query_id", vector, dim), "bounded-queries")
    n_articles = articles.count() if n_articles is None else n_articles
    n_queries = queries.count() if n_queries is None else n_queries
    n_cells = n_cells or min(MAX_CELLS, max(1, math.isqrt(n_articles)))
    homes, cells = _settle(articles, n_cells, n_articles)
    n_query, n_article = _layout(queries, n_queries, n_articles)

    def first(units, least):
        return cells.nearest(units, k)

    def beating(units, least):
        return (cells.bounds(units) - slack + 10.0**-DIGITS >= least[:, None]) & ~cells.nearest(units, k) & (cells.size > 0)

    asked = queries.withColumn("least", F.lit(float("-inf")))
    found = stage(_merge(_met(asked, homes, n_query, n_article, k, first, cell_rows), k).drop("rank"), "first-hits")
    least = found.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf")))
    again = queries.join(least, "query_id").withColumn("least", bound).drop("n")
    hits = _merge(found.unionByName(_met(again, homes, n_query, n_article, k, beating, cell_rows)), k)
    compared = asked.select("query_id", _compared(first, cells.size)).unionByName(again.select("query_id", _compared(beating, cells.size)))
    return hits, compared, cells.size


def vector_topk_bounded(
    queries: DataFrame, articles: DataFrame, k: int = fv.TOP_K, vector: str = "embedding", dim: int | None = None, n_cells: int | None = None,
    slack: float = 0.0, cell_rows: int = CELL_ROWS, n_queries: int | None = None, n_articles: int | None = None,
) -> DataFrame:
    """The rows of ``vector_topk`` without meeting every article: (query_id, id, similarity, rank).

    Articles are grouped round learned centres; a centre and the largest angle to it bound the similarity of all its articles
    to a query. First a query visits the nearest cells that hold k articles, whose k-th hit is the least it
    must beat, then the cells whose bound reaches that. Centres come from ``SAMPLE`` vectors at most and decide only which
    cells are visited. There are as many as the square root of the articles, ``MAX_CELLS`` at most; their sizes and angles are
    all that reaches the driver. ``slack`` makes it approximate: cells must beat the k-th hit by so much. Query ids must differ.
    """
    return _bounded(queries, articles, k, vector, dim, n_cells, slack, cell_rows, n_queries, n_articles)[0]


def vector_visits(
    queries: DataFrame, articles: DataFrame, k: int = fv.TOP_K, vector: str = "embedding", dim: int | None = None, n_cells: int | None = None,
    slack: float = 0.0, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(n_queries, n_cells, n_compared, share): how many of all pairs ``vector_topk_bounded`` compares."""
    _, compared, size = _bounded(queries, articles, k, vector, dim, n_cells, slack, cell_rows, None, None)
    n_queries = F.count_distinct("query_id")
    return compared.filter("n_compared > 0").agg(
        n_queries.alias("n_queries"), F.lit(int((size > 0).sum())).alias("n_cells"), F.coalesce(F.sum("n_compared"), F.lit(0)).alias("n_compared"),
        F.coalesce(F.try_divide(F.sum("n_compared").cast("double"), n_queries * F.lit(int(size.sum()))), F.lit(0.0)).alias("share"),
    )


def vector_rank(hits: DataFrame) -> DataFrame:
    """Drops hits without positive similarity and numbers the rest 1..n per query: adds vec_rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.filter(F.col("similarity") > 0).withColumn("vec_rank", F.row_number().over(order))
