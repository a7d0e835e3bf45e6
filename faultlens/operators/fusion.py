"""Merging the ranked hits of several searches.

Input everywhere: hits(query_id, id, source, rank, n_fts) with source in fts, like, vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from faultlens.functions import fixed_values as fv

SOURCES = ["fts", "like", "vector"]


def _priority():
    out = F.lit(len(SOURCES))
    for i, name in enumerate(SOURCES):
        out = F.when(F.col("source") == name, i).otherwise(out)
    return out


def _ranks(hits: DataFrame) -> DataFrame:
    """One row per query and article: its rank in each source, the first source, the rank there, n_fts.

    Only integers are aggregated, which keeps this a hash aggregation.
    """
    ranks = hits.groupBy("query_id", "id").agg(
        *[F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank") for s in SOURCES],
        F.max("n_fts").alias("n_fts"),
    )
    first = F.lit(None).cast("string")
    for source in reversed(SOURCES):
        first = F.when(F.col(f"{source}_rank").isNotNull(), source).otherwise(first)
    return ranks.withColumn("source", first).withColumn("rank", F.coalesce(*[f"{s}_rank" for s in SOURCES]))


def merge_sources(hits: DataFrame) -> DataFrame:
    """Every article once per query, as the first source found it: adds ft_score and vec_score.

    Full-text hits score n..1 from best to last, substring hits a constant, vector hits their rank.
    """
    return _ranks(hits).select(
        "query_id", "id", "source", "rank",
        F.when(F.col("source") == "fts", (F.col("n_fts") - F.col("rank") + 1).cast("double"))
        .when(F.col("source") == "like", F.lit(fv.LIKE_SCORE)).alias("ft_score"),
        F.when(F.col("source") == "vector", F.col("rank").cast("double")).alias("vec_score"),
    )


def rrf_score(merged: DataFrame) -> DataFrame:
    """Score of the merged rows: 1/(60+ft) + 1/(60+vec) over the scores that are there."""

    def part(name: str):
        return F.when(F.col(name) > 0, F.lit(1.0) / (F.lit(float(fv.RRF_K)) + F.col(name))).otherwise(F.lit(0.0))

    return merged.withColumn("rrf_score", part("ft_score") + part("vec_score"))


def rrf_fused(hits: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion: every source that found the article adds 1/(60+rank).

    The sum runs over fixed columns, not over rows, so equal rankings give bit-equal scores.
    """
    def part(source: str):
        return F.coalesce(F.lit(1.0) / (F.lit(float(fv.RRF_K)) + F.col(f"{source}_rank")), F.lit(0.0))

    total = part(SOURCES[0])
    for source in SOURCES[1:]:
        total = total + part(source)
    return _ranks(hits).select("query_id", "id", "source", "rank", total.alias("rrf_score"))


def score_normalise(scored: DataFrame) -> DataFrame:
    """Divides by the best score of the query (by 1 if that is not positive): adds similarity_score."""
    best = F.max("rrf_score").over(Window.partitionBy("query_id"))
    return scored.withColumn("_best", best).withColumn(
        "similarity_score", F.col("rrf_score") / F.when(F.col("_best") > 0, F.col("_best")).otherwise(F.lit(1.0))
    ).drop("_best")


def score_threshold(scored: DataFrame, threshold: float = fv.SCORE_THRESHOLD) -> DataFrame:
    return scored.filter(F.col("similarity_score") >= threshold)


def first_k(scored: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    """Best k per query, ties by source, then rank, then id: adds hit_rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), _priority(), "rank", "id")
    return scored.withColumn("hit_rank", F.row_number().over(order)).filter(F.col("hit_rank") <= k)


def fuse(hits: DataFrame, k: int = fv.TOP_K, threshold: float = fv.SCORE_THRESHOLD, method: str = "fused") -> DataFrame:
    """Hits to the final list: (query_id, hit_rank, id, similarity_score).

    ``method`` is "fused" (sources add up) or "first_source" (an article counts for its first source only).
    Hits are shuffled once, by query; all grouping and ranking below reuses that partitioning.
    """
    if method not in ("fused", "first_source"):
        raise ValueError(f"unknown fusion method: {method}")
    hits = hits.repartition("query_id")
    scored = rrf_fused(hits) if method == "fused" else rrf_score(merge_sources(hits))
    best = first_k(score_threshold(score_normalise(scored), threshold), k)
    return best.select("query_id", "hit_rank", "id", "similarity_score")
