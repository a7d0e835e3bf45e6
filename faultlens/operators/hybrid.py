"""Hybrid search: full text, substring and vector hits of preprocessed logs, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.operators.embedding import hashed_vectors
from faultlens.operators.fusion import fuse
from faultlens.operators.postings import SearchIndex
from faultlens.operators.textsearch import text_hits
from faultlens.operators.vectorsearch import vector_rank, vector_topk


def vector_hits(logs: DataFrame, kb: DataFrame, k: int = fv.TOP_K, embed=hashed_vectors, search=vector_topk) -> DataFrame:
    """Vector part for logs(query_id, processed_text) and kb(id, embedding).

    ``embed(df, key, text)`` must use the model the articles were embedded with; ``search`` is the exact
    or the approximate top-k.
    """
    asked = embed(logs, "query_id", "processed_text")
    # the keys are counted before any text or vector work, to size the blocks
    n_queries, n_articles = logs.select("query_id").count(), kb.select("id").count()
    found = search(asked, kb.select("id", "embedding"), k, n_queries=n_queries, n_articles=n_articles)
    best = vector_rank(found)
    return best.select(
        "query_id", "id", F.lit("vector").alias("source"), F.col("vec_rank").alias("rank"),
        F.lit(0).alias("n_fts"),
    )


def all_hits(
    logs: DataFrame, kb: DataFrame, k: int = fv.TOP_K, embed=hashed_vectors, search=vector_topk, index: SearchIndex | None = None
) -> DataFrame:
    """hits(query_id, id, source, rank, n_fts) of every source; ``embed=None`` leaves vectors out.

    ``index`` holds the words and symptoms of just these articles; without it they are split anew.
    """
    hits = text_hits(logs, kb, k, index)
    if embed is not None:
        hits = hits.unionByName(vector_hits(logs, kb, k, embed, search))
    return hits


def hybrid_search(
    logs: DataFrame,
    kb: DataFrame,
    k: int = fv.TOP_K,
    threshold: float = fv.SCORE_THRESHOLD,
    method: str = "fused",
    embed=hashed_vectors,
    search=vector_topk,
    index: SearchIndex | None = None,
) -> DataFrame:
    """logs(query_id, keywords, processed_text) -> (query_id, hit_rank, id, similarity_score)."""
    return fuse(all_hits(logs, kb, k, embed, search, index), k, threshold, method)


def with_articles(hits: DataFrame, kb: DataFrame) -> DataFrame:
    """Fetches title, content and category for the final hits only."""
    return hits.join(kb.select("id", "title", "content", "category"), "id")


def retrieved_ids(hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, retrieved_doc_ids) with the ids comma-joined in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("hit_rank", "id")))
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_hits"),
        F.array_join(F.transform(ordered, lambda h: h.id.cast("string")), ",").alias("retrieved_doc_ids"),
    )
