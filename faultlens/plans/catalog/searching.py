"""Full-text, substring and vector search, fusion."""

from __future__ import annotations

import hashlib
import math
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from faultlens.functions.text import embed_text
from faultlens.functions.vectors import cosine_similarity, float32_vector
from faultlens.operators import fusion, textsearch as ts, vectorsearch as vs
from faultlens.operators.embedding import hashed_vector, hashed_vectors, model_vectors
from faultlens.operators.hybrid import all_hits, hybrid_search, retrieved_ids, with_articles
from faultlens.operators.postings import search_index
from faultlens.plans.catalog import sql as s
from faultlens.plans.catalog.knowledge import micros
from faultlens.plans.diagnose import prepare_logs
from faultlens.session import work_path
from faultlens.sources import views
from faultlens.sources.stage import stage


def _passages(spark, d):
    return views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _kb(spark, d):
    return views.spread(views.kb_text(spark, d), "id")


def _round(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


def prepared(spark, d):
    return prepare_logs(views.raw_logs(spark, d).withColumnRenamed("log_id", "query_id"))


def kb_embedded(spark, d):
    """Articles with the hashed vector of title and content, written once."""
    kb = _kb(spark, d)
    return stage(kb.withColumn("embedding", hashed_vector(embed_text(F.col("title"), F.col("content")))), "kb")


def vectors_with_failures(df, key, text):
    """A service that fails for a quarter of the texts: those logs have the text sources alone."""
    return hashed_vectors(df.select(key, F.when(F.md5(text) >= "4", F.col(text)).alias(text)), key, text)


def embed_column(spark, d):
    kb = _kb(spark, d)
    texts = kb.select("id", embed_text(F.col("title"), F.col("content")).alias("text"))
    vectors = hashed_vectors(texts, "id", "text")
    return vectors.select("id", micros(F.col("embedding")).alias("embedding_micros"))


def _text_client():
    """Stands in for an embedding service: eight numbers from the hash of the text, an error for some texts."""

    def embed(text):
        digest = hashlib.md5(text.encode()).digest()
        if digest[15] < 16:
            raise RuntimeError("busy")
        return [b / 256 for b in digest[:8]]

    return embed


def model_vectors_query(spark, d):
    texts = _kb(spark, d).select("id", embed_text(F.col("title"), F.col("content")).alias("text"))
    vectors = model_vectors(texts, "id", "text", _text_client, waits=(0, 0))
    return vectors.select("id", micros(F.col("embedding")).alias("embedding_micros"))


def fts_match(spark, d):
    return _round(ts.fts_match(_passages(spark, d), _kb(spark, d)), "score")


def fts_topk(spark, d):
    return _round(ts.fts_topk(_passages(spark, d), _kb(spark, d)), "score")


def fts_keywords(spark, d):
    asked = prepared(spark, d).select("query_id", F.array_join("keywords", " ").alias("query_text"))
    return _round(ts.fts_topk(asked, _kb(spark, d)), "score")


def like_match(spark, d):
    return ts.like_match(prepared(spark, d).select("query_id", "keywords"), _kb(spark, d))


def _open_keywords(spark, d):
    """Keywords outside the closed list: the first word of every passage, and one word of the list."""
    first = F.regexp_extract(F.lower("query_text"), "[a-z]{4,}", 0)
    return _passages(spark, d).select("query_id", F.array(first, F.lit("timeout"), F.lit("of")).alias("keywords"))


def like_open(spark, d):
    return ts.like_match(_open_keywords(spark, d), _kb(spark, d))


def kept_index(spark, kb):
    """Kept lists of the articles: first some of them, some in an older state; then changes, additions and removals."""
    index = search_index(spark, work_path(spark, "kept-index"))
    old = F.when(F.col("id") % 10 == 0, F.concat(F.lit("outdated timeout "), "keywords")).otherwise(F.col("content"))
    index.add(kb.filter("id % 7 <> 3").withColumn("content", old), 0)
    index.add(kb.filter("(id % 10 = 0 OR id % 7 = 3) AND id % 50 <> 49"), 1, kb.filter("id % 50 = 49"))
    return index


def fts_topk_kept(spark, d):
    kb = _kb(spark, d)
    return _round(ts.fts_topk(_passages(spark, d), kb, index=kept_index(spark, kb)), "score")


def like_open_kept(spark, d):
    kb = _kb(spark, d)
    return ts.like_match(_open_keywords(spark, d), kb.filter("id % 50 <> 49"), index=kept_index(spark, kb))


def like_distinct(spark, d):
    return ts.like_distinct(prepared(spark, d).select("query_id", "keywords"), _kb(spark, d))


def _vectors(spark, d):
    e = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id")


def vector_topk(spark, d):
    return vs.vector_topk(*_vectors(spark, d))


def vector_topk_ann(spark, d):
    return vs.vector_topk_ann(*_vectors(spark, d), n_bits=_ANN_BITS)


def vector_topk_bounded(spark, d):
    return vs.vector_topk_bounded(*_vectors(spark, d))


def vector_visits(spark, d):
    """Pairs compared by the bounded search, exact and with slack, and the share of the neighbours found with it."""
    queries, articles = _vectors(spark, d)
    exact = vs.vector_topk(queries, articles).select("query_id", "id")
    parts = []
    for slack in (0.0, 0.3):
        found = vs.vector_topk_bounded(queries, articles, slack=slack).select("query_id", "id", F.lit(1).alias("hit"))
        recall = exact.join(found, ["query_id", "id"], "left").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
        parts.append(vs.vector_visits(queries, articles, slack=slack).crossJoin(recall).withColumn("slack", F.lit(slack)))  # one row each
    return parts[0].unionByName(parts[1])


def vector_ann_recall(spark, d):
    """Share of the exact neighbours that the approximate search finds, by number of bits, for every hundredth vector."""
    queries, articles = _vectors(spark, d)
    queries = queries.filter("query_id % 100 = 0")
    exact = vs.vector_topk(queries, articles).select("query_id", "id")
    found = [
        vs.vector_topk_ann(queries, articles, n_bits=bits).select("query_id", "id", F.lit(bits).alias("n_bits"))
        for bits in _RECALL_BITS
    ]
    hits = reduce(DataFrame.unionByName, found).withColumn("hit", F.lit(1))
    asked = exact.withColumn("n_bits", F.explode(F.array(*map(F.lit, _RECALL_BITS))))
    return asked.join(hits, ["n_bits", "query_id", "id"], "left").groupBy("n_bits").agg(
        F.count(F.lit(1)).alias("n_neighbours"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall")
    )


def vector_rank(spark, d):
    return vs.vector_rank(vs.vector_topk(*_vectors(spark, d))).select("query_id", "id", "similarity", "vec_rank")


def cosine_query(spark, d):
    queries, articles = _vectors(spark, d)
    following = articles.select((F.col("id") - 1).alias("query_id"), F.col("embedding").alias("other"))
    sim = cosine_similarity(F.col("embedding"), F.col("other"))
    return queries.join(following, "query_id", "left").select("query_id", F.round(F.coalesce(sim, F.lit(0.0)), 6).alias("similarity"))


def float32_vectors(spark, d):
    wide = F.transform("embedding", lambda x: x.cast("double") / F.lit(3.0))
    narrow = F.aggregate(float32_vector(wide), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return views.table(spark, d, "embeddings").select("vec_id", F.round(narrow, 6).alias("total"))


def _hits(spark, d, **options):
    return all_hits(prepared(spark, d), kb_embedded(spark, d), **options)


def merge_sources(spark, d):
    return fusion.merge_sources(_hits(spark, d)).select("query_id", "id", "source", "rank", "ft_score", "vec_score")


def rrf_score(spark, d):
    scored = fusion.rrf_score(fusion.merge_sources(_hits(spark, d)))
    return _round(scored.select("query_id", "id", "source", "rrf_score"), "rrf_score")


def rrf_fused(spark, d):
    return _round(fusion.rrf_fused(_hits(spark, d)).select("query_id", "id", "source", "rrf_score"), "rrf_score")


def score_normalise(spark, d):
    scored = fusion.score_normalise(fusion.rrf_fused(_hits(spark, d)))
    return _round(scored.select("query_id", "id", "similarity_score"), "similarity_score")


def score_threshold(spark, d):
    scored = fusion.score_normalise(fusion.rrf_fused(_hits(spark, d)))
    return _round(fusion.score_threshold(scored, 0.4).select("query_id", "id", "similarity_score"), "similarity_score")


def hybrid(spark, d, method="fused"):
    return _round(hybrid_search(prepared(spark, d), kb_embedded(spark, d), method=method), "similarity_score")


def hybrid_articles(spark, d):
    kb = kb_embedded(spark, d)
    found = with_articles(hybrid_search(prepared(spark, d), kb), kb)
    return _round(found.withColumn("content", F.md5("content")), "similarity_score")


def hybrid_text_only(spark, d):
    found = hybrid_search(prepared(spark, d), _kb(spark, d), embed=None)
    return _round(found, "similarity_score")


def retrieved(spark, d):
    return retrieved_ids(hybrid_search(prepared(spark, d), kb_embedded(spark, d)))


QUERIES = {
    "embed_column": embed_column,
    "model_vectors": model_vectors_query,
    "fts_match": fts_match,
    "fts_topk": fts_topk,
    "fts_topk_kept": fts_topk_kept,
    "fts_keywords": fts_keywords,
    "like_match_open_kept": like_open_kept,
    "like_match": like_match,
    "like_match_open": like_open,
    "like_distinct": like_distinct,
    "vector_topk": vector_topk,
    "vector_topk_ann": vector_topk_ann,
    "vector_topk_bounded": vector_topk_bounded,
    "vector_visits": vector_visits,
    "vector_ann_recall": vector_ann_recall,
    "vector_rank": vector_rank,
    "cosine_similarity": cosine_query,
    "float32_vectors": float32_vectors,
    "merge_sources": merge_sources,
    "rrf_score": rrf_score,
    "rrf_fused": rrf_fused,
    "score_normalise": score_normalise,
    "score_threshold": score_threshold,
    "hybrid_search": hybrid,
    "hybrid_search_first_source": partial(hybrid, method="first_source"),
    "hybrid_search_text_only": hybrid_text_only,
    "hybrid_search_articles": hybrid_articles,
    "retrieved_ids": retrieved,
}

_W = s.with_
_P = [s.LOGS, s.KB, s.prepared()]
_LIVE = "live AS (SELECT * FROM kb WHERE id % 50 <> 49)"
_OPEN = "asked AS (SELECT item_id, [regexp_extract(lower(text), '[a-z]{4,}'), 'timeout', 'of'] AS keywords FROM benchmark)"
_BENCH = [s.KB, s.fts("benchmark", "item_id", "text")]
_ANN_BITS = 3
_RECALL_BITS = (3, 6, 8)
_VISITED = math.ceil(vs.PROBED * 2**_ANN_BITS)
_PLANES = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in plane)}]::DOUBLE[])" for i, plane in enumerate(vs.hyperplanes(_ANN_BITS, 64)))
_ANN = [f"planes(p, plane) AS (VALUES {_PLANES})", f"""
margins AS (
  SELECT vec_id, p, list_inner_product(CAST(embedding AS DOUBLE[]), plane) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS m
  FROM embeddings, planes WHERE embedding IS NOT NULL),
homes AS (SELECT vec_id, CAST(sum(CASE WHEN m > 0 THEN 1 << p ELSE 0 END) AS BIGINT) AS cell FROM margins GROUP BY vec_id),
across AS (
  SELECT vec_id, crossed FROM (
    SELECT vec_id, crossed, sum(CASE WHEN (crossed >> p) & 1 = 1 THEN m * m ELSE 0 END) AS far FROM margins, range({2**_ANN_BITS}) r(crossed) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, crossed) <= {_VISITED}),
visits AS (SELECT h.vec_id, xor(h.cell, a.crossed) AS cell FROM homes h JOIN across a ON a.vec_id = h.vec_id)""",
    s.nearest("embeddings", "vec_id", "embeddings", "vec_id", "near", where="""EXISTS (
    SELECT 1 FROM visits v JOIN homes h ON h.cell = v.cell WHERE v.vec_id = q.vec_id AND h.vec_id = a.vec_id)"""),
    s.nearest("embeddings", "vec_id", "embeddings", "vec_id", "exact"), f"""
short AS (SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT qid FROM near GROUP BY qid HAVING count(*) >= {s.fv.TOP_K})),
ann AS (SELECT * FROM near WHERE qid NOT IN (FROM short) UNION ALL SELECT * FROM exact WHERE qid IN (FROM short))"""]
_ALL = _W(*_P, s.hits(), s.FUSED, s.ranked())
ORACLE = {
    "embed_column": _W(s.KB, "kbt AS (SELECT id, title || chr(10) || content AS txt FROM kb)", s.hashed("kbt", "id", "txt", "v"))
    + f"SELECT id, {s.micros('embedding')} AS embedding_micros FROM v",
    "model_vectors": _W(s.KB, "h AS (SELECT id, md5(title || chr(10) || content) AS h FROM kb)",
                        """v AS (SELECT id, CASE WHEN h[31] <> '0' THEN list_transform(range(0, 8),
  lambda i: CAST(strpos('123456789abcdef', h[2 * i + 1]) * 16 + strpos('123456789abcdef', h[2 * i + 2]) AS DOUBLE) / 256) END AS embedding FROM h)""")
    + f"SELECT id, {s.micros('embedding')} AS embedding_micros FROM v",
    "fts_match": _W(*_BENCH) + "SELECT qid AS query_id, id, round(score, 6) AS score FROM fts_all",
    "fts_topk": _W(*_BENCH) + "SELECT qid AS query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM fts",
    "fts_keywords": _W(*_P, "asked AS (SELECT log_id, array_to_string(keywords, ' ') AS qt FROM prep)", s.fts("asked", "log_id", "qt"))
    + "SELECT qid AS query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM fts",
    "like_match": _W(*_P, s.like("prep", "log_id")) + "SELECT qid AS query_id, keyword, id FROM like_all",
    "fts_topk_kept": _W(s.KB, _LIVE, s.fts("benchmark", "item_id", "text", "live"))
    + "SELECT qid AS query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM fts",
    "like_match_open_kept": _W(s.KB, _LIVE, _OPEN, s.like("asked", "item_id", "live"))
    + "SELECT qid AS query_id, keyword, id FROM like_all",
    "like_match_open": _W(s.KB, _OPEN, s.like("asked", "item_id"))
    + "SELECT qid AS query_id, keyword, id FROM like_all",
    "like_distinct": _W(*_P, s.like("prep", "log_id")) + "SELECT qid AS query_id, id, CAST(rank AS INT) AS rank FROM like_one",
    "vector_topk": _W(s.nearest("embeddings", "vec_id", "embeddings", "vec_id", "near"))
    + "SELECT qid AS query_id, id, similarity, CAST(rank AS INT) AS rank FROM near",
    "vector_topk_ann": _W(*_ANN) + "SELECT qid AS query_id, id, similarity, CAST(rank AS INT) AS rank FROM ann",
    "vector_topk_bounded": _W(s.nearest("embeddings", "vec_id", "embeddings", "vec_id", "near"))
    + "SELECT qid AS query_id, id, similarity, CAST(rank AS INT) AS rank FROM near",
    "vector_rank": _W(s.nearest("embeddings", "vec_id", "embeddings", "vec_id", "near"))
    + """SELECT qid AS query_id, id, similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INT) AS vec_rank
FROM near WHERE similarity > 0""",
    "cosine_similarity": """SELECT a.vec_id AS query_id, coalesce(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
  CAST(b.embedding AS DOUBLE[])), 6), 0.0) AS similarity FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "float32_vectors": """SELECT vec_id, round(list_sum(list_transform(embedding,
  lambda x: CAST(CAST(CAST(x AS DOUBLE) / 3.0::DOUBLE AS FLOAT) AS DOUBLE))), 6) AS total FROM embeddings""",
    "merge_sources": _W(*_P, s.hits(), s.FIRST_SOURCE)
    + "SELECT qid AS query_id, id, source, CAST(rank AS INT) AS rank, CAST(ft_score AS DOUBLE) AS ft_score, vec_score FROM merged",
    "rrf_score": _W(*_P, s.hits(), s.FIRST_SOURCE) + "SELECT qid AS query_id, id, source, round(rrf, 6) AS rrf_score FROM scored",
    "rrf_fused": _ALL + "SELECT qid AS query_id, id, source, round(rrf, 6) AS rrf_score FROM scored",
    "score_normalise": _ALL + "SELECT qid AS query_id, id, round(similarity_score, 6) AS similarity_score FROM normed",
    "score_threshold": _ALL + "SELECT qid AS query_id, id, round(similarity_score, 6) AS similarity_score FROM normed WHERE similarity_score >= 0.4",
    "hybrid_search": _ALL + "SELECT qid AS query_id, CAST(hit_rank AS INT) AS hit_rank, id, round(similarity_score, 6) AS similarity_score FROM final",
    "hybrid_search_first_source": _W(*_P, s.hits(), s.FIRST_SOURCE, s.ranked())
    + "SELECT qid AS query_id, CAST(hit_rank AS INT) AS hit_rank, id, round(similarity_score, 6) AS similarity_score FROM final",
    "hybrid_search_text_only": _W(*_P, s.hits(vectors=False), s.FUSED, s.ranked())
    + "SELECT qid AS query_id, CAST(hit_rank AS INT) AS hit_rank, id, round(similarity_score, 6) AS similarity_score FROM final",
    "hybrid_search_articles": _ALL + """SELECT qid AS query_id, CAST(hit_rank AS INT) AS hit_rank, final.id,
  round(similarity_score, 6) AS similarity_score, title, md5(content) AS content, category FROM final JOIN kb ON kb.id = final.id""",
    "retrieved_ids": _ALL + """SELECT qid AS query_id, CAST(count(*) AS INT) AS n_hits,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY hit_rank) AS retrieved_doc_ids FROM final GROUP BY qid""",
}
