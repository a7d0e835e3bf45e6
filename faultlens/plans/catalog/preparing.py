"""Log preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions import text as tx
from faultlens.functions.masking import mask
from faultlens.functions.tagging import key_errors
from faultlens.operators import preprocess as pp
from faultlens.plans.catalog import sql as s
from faultlens.sources import views

SMALL = 300  # token limit that makes the derived logs too long
LIMIT = SMALL * fv.BYTES_PER_TOKEN


def _documents(spark, d):
    return views.spread(views.table(spark, d, "documents"), "doc_id")


def mask_pii(spark, d):
    docs = _documents(spark, d).select("doc_id", mask(F.col("text")).alias("masked"))
    logs = views.raw_logs(spark, d).select((-F.col("log_id") - 1).alias("doc_id"), mask(F.col("content")).alias("masked"))
    return docs.unionByName(logs)


def mask_counts(spark, d):
    return pp.mask_counts(_documents(spark, d), "text", "source")


def line_weights(spark, d):
    return pp.line_weights(views.raw_logs(spark, d).select("log_id", "content"))


def truncate_log(spark, d):
    masked = views.raw_logs(spark, d).select("log_id", mask(F.col("content")).alias("masked"))
    return pp.truncate_lines(masked, "masked", "short", SMALL).select("log_id", "short")


def truncate_documents(spark, d):
    return pp.truncate_lines(_documents(spark, d).select("doc_id", "text"), "text", "short").select(
        "doc_id", F.octet_length("short").alias("n_bytes"), F.md5("short").alias("short_md5")
    )


def log_fingerprint(spark, d):
    return _documents(spark, d).select("doc_id", tx.log_fingerprint(mask(F.col("text"))).alias("log_hash"))


def raw_hash_short(spark, d):
    return _documents(spark, d).select("doc_id", tx.raw_hash_short(F.col("text")).alias("raw_hash"))


def token_estimate(spark, d):
    return _documents(spark, d).select("doc_id", tx.token_estimate(F.col("text")).alias("token_count"))


def key_errors_query(spark, d):
    return views.raw_logs(spark, d).select("log_id", F.array_join(key_errors(F.col("content")), "|").alias("key_errors"))


def key_error_counts(spark, d):
    tagged = views.raw_logs(spark, d).select("log_id", key_errors(F.col("content")).alias("key_errors"))
    return pp.key_error_counts(tagged)


def retrieval_keywords(spark, d):
    tagged = views.raw_logs(spark, d).select(
        "log_id", F.col("content").alias("processed_text"), key_errors(F.col("content")).alias("key_errors")
    )
    return pp.with_keywords(tagged).select("log_id", F.array_join("keywords", "|").alias("keywords"))


def preprocess(spark, d):
    done = pp.preprocess(views.raw_logs(spark, d).select("log_id", "content"), max_tokens=SMALL)
    return done.select(
        "log_id", "processed_text", "original_hash", "token_count", F.array_join("key_errors", "|").alias("key_errors")
    )


def clip_chars(spark, d):
    text = F.col("text")
    return _documents(spark, d).select(
        "doc_id", tx.clip_chars(text, fv.TITLE_CHARS).alias("title"), tx.clip_chars(text, fv.SNIPPET_CHARS).alias("snippet")
    )


def clip_bytes(spark, d):
    return _documents(spark, d).select("doc_id", tx.clip_bytes(F.col("text"), fv.CASE_SNIPPET_BYTES).alias("snippet"))


def timestamp_range(spark, d):
    logs = views.raw_logs(spark, d).select("log_id", tx.timestamp_range(F.col("content")).alias("r"))
    return logs.select("log_id", F.col("r.start").cast("string").alias("start_ts"), F.col("r.end").cast("string").alias("end_ts"))


QUERIES = {
    "mask_pii": mask_pii,
    "mask_counts": mask_counts,
    "line_weights": line_weights,
    "truncate_log": truncate_log,
    "truncate_documents": truncate_documents,
    "log_fingerprint": log_fingerprint,
    "raw_hash_short": raw_hash_short,
    "token_estimate": token_estimate,
    "key_errors": key_errors_query,
    "key_error_counts": key_error_counts,
    "retrieval_keywords": retrieval_keywords,
    "preprocess": preprocess,
    "clip_chars": clip_chars,
    "clip_bytes": clip_bytes,
    "timestamp_range": timestamp_range,
}

_W = s.with_
ORACLE = {
    "mask_pii": _W(s.LOGS) + f"""SELECT doc_id, {s.mask('text')} AS masked FROM documents
UNION ALL SELECT -log_id - 1, {s.mask('content')} FROM logs""",
    "mask_counts": "SELECT source, count(*) AS n_texts, "
    + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {r}_hits" for r, n in s.mask_stages("text"))
    + " FROM documents GROUP BY source",
    "line_weights": _W(s.LOGS, """
parts AS (SELECT log_id, string_split(content, chr(10)) AS ls FROM logs),
rows AS (SELECT log_id, CAST(unnest(range(0, len(ls))) AS INT) AS i, unnest(ls) AS line FROM parts)""")
    + f"SELECT log_id, i, line, {s.weight('line')} AS weight FROM rows",
    "truncate_log": _W(s.LOGS, f"masked AS (SELECT log_id, {s.mask('content')} AS masked FROM logs)",
                       s.truncated("masked", "log_id", "masked", LIMIT, "cut")) + "SELECT log_id, short FROM cut",
    "truncate_documents": _W(s.truncated("documents", "doc_id", "text", fv.MAX_TOKENS * fv.BYTES_PER_TOKEN, "cut"))
    + "SELECT doc_id, CAST(strlen(short) AS INT) AS n_bytes, md5(short) AS short_md5 FROM cut",
    "log_fingerprint": f"SELECT doc_id, sha256({s.mask('text')}) AS log_hash FROM documents",
    "raw_hash_short": "SELECT doc_id, substr(sha256(text), 1, 32) AS raw_hash FROM documents",
    "token_estimate": "SELECT doc_id, CAST(strlen(text) // 3 AS INT) AS token_count FROM documents",
    "key_errors": _W(s.LOGS) + f"SELECT log_id, array_to_string({s.key_errors('content')}, '|') AS key_errors FROM logs",
    "key_error_counts": _W(s.LOGS, f"tags AS (SELECT unnest({s.key_errors('content')}) AS key_error FROM logs)")
    + "SELECT key_error, count(*) AS n_logs FROM tags GROUP BY key_error",
    "retrieval_keywords": _W(s.LOGS, "raw AS (SELECT log_id, content FROM logs)", f"""
t0 AS (SELECT log_id, content, list_concat({s.key_errors('content')}, list_filter({s.arr(fv.RETRIEVAL_WORDS)},
  lambda p: contains(upper(content), upper(p)))) AS found FROM raw),
t1 AS (SELECT log_id, list_filter(found, lambda w, i:
  list_position(list_transform(found, lambda z: upper(z)), upper(w)) = i) AS u FROM t0)""")
    + f"SELECT log_id, array_to_string(CASE WHEN len(u) = 0 THEN {s.arr(fv.DEFAULT_WORDS)} ELSE u END, '|') AS keywords FROM t1",
    "preprocess": _W(s.LOGS, s.prepared(limit=LIMIT)) + """SELECT log_id, short AS processed_text, original_hash, token_count,
  array_to_string(key_errors, '|') AS key_errors FROM prep""",
    "clip_chars": f"""SELECT doc_id, {s.clip('text', fv.TITLE_CHARS)} AS title, {s.clip('text', fv.SNIPPET_CHARS)} AS snippet
FROM documents""",
    "clip_bytes": f"SELECT doc_id, {s.clip_bytes('text', fv.CASE_SNIPPET_BYTES)} AS snippet FROM documents",
    "timestamp_range": _W(s.LOGS, r"""
found AS (SELECT log_id, regexp_extract_all(content, '\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}') AS t FROM logs)""")
    + "SELECT log_id, list_min(t) AS start_ts, list_max(t) AS end_ts FROM found",
}
