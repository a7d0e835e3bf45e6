"""Prompts, model answers and the whole diagnosis."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from faultlens.functions import answers as an
from faultlens.functions import fixed_values as fv
from faultlens.functions.masking import mask
from faultlens.functions.prompts import pick_strategy
from faultlens.functions.text import log_fingerprint, token_estimate, whole_div
from faultlens.operators import knowledge as kn
from faultlens.operators.hybrid import hybrid_search, retrieved_ids
from faultlens.operators.inference import answers_kept, model_answers, recorded_answers
from faultlens.operators.prompting import assemble_prompt, miss_to_cot
from faultlens.plans.catalog import sql as s
from faultlens.plans.catalog.knowledge import NOW, _now, _embedded, _table, _state
from faultlens.plans.catalog.searching import kb_embedded, prepared, vectors_with_failures
from faultlens.plans.diagnose import bad_answers, build_prompts, diagnose_and_store, diagnose_batch
from faultlens.session import work_path
from faultlens.sources import views
from faultlens.sources.stage import stage

FIRST_WEEK_END = "2024-01-08 00:00:00"


def parse_answer(spark, d):
    return an.parse_answers(views.answers(spark, d)).select("conv_id", "turn", "parse_kind")


def answer_fields(spark, d):
    read = an.answer_fields(an.parse_answers(views.answers(spark, d)))
    return read.select(
        "conv_id", "turn", "root_cause", F.col("analysis_process").alias("analysis"),
        F.array_join("solution_steps", "|").alias("steps"), F.round("confidence", 6).alias("confidence"),
    )


def bad_answer_rows(spark, d):
    read = an.answer_fields(an.parse_answers(stage(views.answers(spark, d), "answers")))
    return read.filter(F.col("root_cause") == "").select(
        "conv_id", "turn", "raw_content", F.array_join(an.parsed_keys(F.col("parsed")), ",").alias("parsed_keys")
    )


def strategies(spark, d):
    return views.raw_logs(spark, d).select("log_id", pick_strategy(F.col("strategy")).alias("strategy"))


def miss_to_cot_query(spark, d):
    logs = prepared(spark, d)
    hits = hybrid_search(logs.filter("use_rag"), kb_embedded(spark, d), embed=vectors_with_failures)
    counted = logs.join(retrieved_ids(hits), "query_id", "left").withColumn("strategy", pick_strategy(F.col("strategy")))
    return miss_to_cot(counted).select("query_id", "use_rag", "rag_missed", "strategy")


def assemble_prompt_query(spark, d):
    prompts = build_prompts(prepared(spark, d), kb_embedded(spark, d), embed=vectors_with_failures)
    return prompts.select("query_id", "strategy", "n_hits", F.md5("user_prompt").alias("prompt_md5"), "system_prompt", "expected_format")


def _offline_client():
    """Stands in for a model: answers from the prompt's hash, fails for some prompts."""

    def answer(request):
        user = request["messages"][1]["content"].encode()
        digest = hashlib.md5(user).hexdigest()
        if digest[0] == "0":
            raise RuntimeError("busy")
        return json.dumps({"root_cause": digest[:8], "confidence": 0.5}), len(user) // 3

    return answer


def _direct_prompts(spark, d):
    plain = prepared(spark, d).withColumn("strategy", pick_strategy(F.col("strategy")))
    return assemble_prompt(plain.withColumn("articles", F.lit(None).cast("array<struct<id:long,title:string,content:string>>")))


def llm_answers(spark, d):
    done = model_answers(_direct_prompts(spark, d), ["query_id"], _offline_client, waits=(0, 0, 0))
    return done.select("query_id", "raw_content", "error", "model_used", "total_tokens")


def llm_answers_kept(spark, d):
    """First a third of the prompts, then all of them: the second run asks only what has no answer yet."""
    prompts, store = stage(_direct_prompts(spark, d), "direct-prompts"), work_path(spark, "answer-store")
    options = {"waits": (0, 0, 0), "per_task": 50}
    answers_kept(prompts.filter("query_id % 3 = 0"), ["query_id"], _offline_client, store, **options)
    done = answers_kept(prompts, ["query_id"], _offline_client, store, **options)
    return done.select("query_id", "raw_content", "error", "model_used", "total_tokens")


def _turns(spark, d):
    """The assistant turns of a conversation, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "raw_content")))
    return views.answers(spark, d).groupBy("conv_id").agg(ordered["raw_content"].alias("turns"))


def _turn(number):
    """The turn that answers the prompt of this number: all turns take their part."""
    return F.get("turns", F.pmod(number, F.size("turns")).cast("int"))


def recorded_answers_query(spark, d):
    """Answers recorded under the hash of their prompt, then found again."""
    prompts = _direct_prompts(spark, d).select("query_id", "system_prompt", "user_prompt")
    record = prompts.withColumn("conv_id", whole_div(F.col("query_id"), 4)).join(_turns(spark, d), "conv_id")
    record = record.select(
        F.sha2("user_prompt", 256).alias("prompt_hash"), _turn(F.col("query_id")).alias("raw_content"),
        token_estimate(F.col("user_prompt")).alias("total_tokens"), (F.col("conv_id") + 1000).alias("latency_ms"),
    ).dropDuplicates(["prompt_hash"])
    done = recorded_answers(prompts, record, ["query_id"])
    return done.select("query_id", F.md5("raw_content").alias("raw_md5"), "error", "total_tokens", "latency_ms")


def _answerer(spark, d, key, conv_id, number):
    """Recorded conversations as the model: the prompt's conversation and number pick the answer."""
    turns = _turns(spark, d)

    def answer(prompts):
        asked = prompts.select(*key, token_estimate(F.col("user_prompt")).alias("n_tokens"), conv_id().alias("conv_id"), number().alias("number"))
        found = asked.join(turns, "conv_id", "left").withColumn("raw_content", _turn(F.col("number")))
        missing = F.col("raw_content").isNull()
        return found.select(
            *key, "raw_content", F.when(missing, "no answer").alias("error"), F.lit(fv.MODEL_NAME).alias("model_used"),
            F.when(missing, 0).otherwise(F.col("n_tokens")).alias("total_tokens"),
            (F.col("conv_id") + 1000).cast("long").alias("latency_ms"),
        )

    return answer


def _diagnosis_inputs(spark, d):
    logs = views.raw_logs(spark, d).withColumnRenamed("log_id", "query_id")
    earlier = logs.filter(F.col("ts") < F.lit(FIRST_WEEK_END).cast("timestamp_ntz")).select(
        F.col("query_id").alias("id"), log_fingerprint(mask(F.col("content"))).alias("log_hash"),
        F.struct(
            views.fault(F.col("query_id")).alias("root_cause"), F.lit("").alias("analysis_process"),
            F.array(F.lit("restart")).alias("solution_steps"), F.lit(0.25).alias("confidence"),
        ).alias("diagnosis_result"),
    )
    answer = _answerer(spark, d, ["query_id"], lambda: whole_div(F.col("query_id"), 4), lambda: F.col("query_id"))
    return logs, kb_embedded(spark, d), earlier, answer


def _diagnosed(spark, d):
    return diagnose_batch(*_diagnosis_inputs(spark, d), embed=vectors_with_failures)


def _stored(spark, d):
    logs, kb, earlier, answer = _diagnosis_inputs(spark, d)
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    kb = kb.withColumn("created_at", stamp).withColumn("updated_at", stamp)
    out = work_path(spark, "diagnosed")
    return diagnose_and_store(logs, kb, earlier, answer, out, "r1", _now(), embed=vectors_with_failures)


def diagnose_history(spark, d):
    return _stored(spark, d)["history"].select(
        "id", "session_id", "log_hash", F.md5("log_snippet").alias("snippet_md5"), "retrieved_doc_ids",
        F.col("diagnosis_result.root_cause").alias("root_cause"), F.md5("diagnosis_result.analysis_process").alias("analysis_md5"),
        F.array_join("diagnosis_result.solution_steps", "|").alias("steps"),
        F.round("diagnosis_result.confidence", 6).alias("confidence"), "model_used", "prompt_strategy", "total_tokens",
        "latency_ms", F.col("created_at").cast("string").alias("created"),
    )


def diagnose_articles(spark, d):
    return _table(_stored(spark, d)["articles"])


def diagnose_batch_query(spark, d):
    return _diagnosed(spark, d).select(
        "query_id", "original_hash", "status", "strategy", "rag_missed", "n_hits", "retrieved_doc_ids", "root_cause",
        F.md5("analysis_process").alias("analysis_md5"),
        F.array_join("solution_steps", "|").alias("steps"), F.round("confidence", 6).alias("confidence"),
        "error", "total_tokens", "latency_ms", "history_id",
    )


def diagnose_bad(spark, d):
    bad = bad_answers(stage(_diagnosed(spark, d), "diagnosed"))
    return bad.select("query_id", "raw_content", F.array_join("parsed_keys", ",").alias("parsed_keys"))


def auto_learn(spark, d):
    diagnosed = stage(_diagnosed(spark, d), "diagnosed").filter("status = 'ok'")
    return _table(kn.auto_learn(views.kb_state(spark, d), diagnosed, now=_now()))


QUERIES = {
    "parse_answer": parse_answer,
    "answer_fields": answer_fields,
    "bad_answers": bad_answer_rows,
    "pick_strategy": strategies,
    "miss_to_cot": miss_to_cot_query,
    "assemble_prompt": assemble_prompt_query,
    "llm_answers": llm_answers,
    "llm_answers_kept": llm_answers_kept,
    "recorded_answers": recorded_answers_query,
    "diagnose_batch": diagnose_batch_query,
    "diagnose_bad_answers": diagnose_bad,
    "auto_learn": auto_learn,
    "diagnose_history": diagnose_history,
    "diagnose_articles": diagnose_articles,
}

_W = s.with_
_KEYS = "array_to_string(list_sort(json_keys(js)), ',')"
_TEXT_ONLY = [s.LOGS, s.KB, s.prepared(), "meta AS (SELECT log_id, strategy, use_rag, ts FROM logs)"]
_RAG = [
    *_TEXT_ONLY,
    "rag AS (SELECT * FROM prep WHERE log_id IN (SELECT log_id FROM meta WHERE use_rag))",
    s.hits(logs="rag", embedded=s.EMBEDDED), s.FUSED, s.ranked(), s.PACKED,
    f"""
chosen AS (
  SELECT p.*, m.use_rag, m.ts, coalesce(k.n_hits, 0) AS n_hits, k.retrieved_doc_ids, k.block,
    m.use_rag AND k.n_hits IS NULL AS rag_missed,
    CASE WHEN m.use_rag AND k.n_hits IS NULL THEN 'COT' ELSE {s.strategy('m.strategy')} END AS strategy
  FROM prep p JOIN meta m ON m.log_id = p.log_id LEFT JOIN packed k ON k.qid = p.log_id)""",
    f"prompts AS (SELECT *, {s.prompt('strategy', 'short', 'block')} AS user_prompt FROM chosen)",
]
_DIRECT = [*_TEXT_ONLY, f"""
prompts AS (SELECT log_id, {s.prompt('strategy', 'short', 'NULL')} AS user_prompt FROM (
  SELECT p.log_id, p.short, {s.strategy('m.strategy')} AS strategy FROM prep p JOIN meta m ON m.log_id = p.log_id))"""]
_TURNS = s.ANSWERS + ",\nturns AS (SELECT conv_id, list(raw_content ORDER BY turn) AS turns FROM answers GROUP BY conv_id)"


def _turn_sql(number):
    return f"turns[1 + {number} % len(turns)]"



_DIAGNOSED = [
    *_RAG, _TURNS, """
asked AS (
  SELECT p.*, log_id // 4 + 1000 AS latency_ms, """ + _turn_sql("log_id") + """ AS raw_content,
    CASE WHEN turns IS NULL THEN 0 ELSE strlen(user_prompt) // 3 END AS total_tokens,
    CASE WHEN turns IS NULL THEN 'no answer' END AS error
  FROM prompts p LEFT JOIN turns f ON f.conv_id = p.log_id // 4 WHERE ts >= TIMESTAMP '""" + FIRST_WEEK_END + "')",
    s.parsed("asked", "raw_content"),
    "done AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN root_cause = '' THEN 'bad' ELSE 'ok' END AS status FROM read)",
]
_LEARNED = [f"""
learned AS (
  SELECT {s.clip('root_cause', fv.TITLE_CHARS)} AS title, {s.learned('root_cause', 'analysis_process', 'solution_steps')} AS content,
    {s.category_of('key_errors')} AS category, array_to_string(key_errors, ',') AS keywords,
    array_to_string(key_errors, ',') AS symptoms
  FROM done WHERE status = 'ok' AND rag_missed AND parse_kind <> 'failed'),
numbered AS (
  SELECT *, (SELECT max(id) FROM kb) + row_number() OVER (
    ORDER BY md5(concat_ws(chr(1), title, content, category, keywords, symptoms))) AS id FROM learned)""", _embedded("numbered")]
# the service of the queries fails for some texts
_SERVICE_VECTORS = ["""
served AS (SELECT n.*, CASE WHEN md5(n.title || chr(10) || n.content) >= '4' THEN f.embedding END AS embedding
  FROM numbered n JOIN fresh f ON f.id = n.id)"""]
ORACLE = {
    "parse_answer": _W(s.ANSWERS, s.parsed("answers", "raw_content")) + "SELECT conv_id, turn, parse_kind FROM read",
    "answer_fields": _W(s.ANSWERS, s.parsed("answers", "raw_content")) + """SELECT conv_id, turn, root_cause,
  analysis_process AS analysis,
  array_to_string(solution_steps, '|') AS steps, round(confidence, 6) AS confidence FROM read""",
    "bad_answers": _W(s.ANSWERS, s.parsed("answers", "raw_content"))
    + f"SELECT conv_id, turn, raw_content, {_KEYS} AS parsed_keys FROM read WHERE root_cause = ''",
    "pick_strategy": _W(s.LOGS) + f"SELECT log_id, {s.strategy('strategy')} AS strategy FROM logs",
    "miss_to_cot": _W(*_RAG) + "SELECT log_id AS query_id, use_rag, rag_missed, strategy FROM chosen",
    "assemble_prompt": _W(*_RAG) + f"""SELECT log_id AS query_id, strategy, CAST(n_hits AS INT) AS n_hits,
  md5(user_prompt) AS prompt_md5, {s.lit(s.pr.SYSTEM_PROMPT)} AS system_prompt, {s.lit(s.pr.EXPECTED_FORMAT)} AS expected_format FROM prompts""",
    "llm_answers": _W(*_DIRECT, "h AS (SELECT *, md5(user_prompt) AS m FROM prompts)") + f"""SELECT log_id AS query_id,
  CASE WHEN m[1] <> '0' THEN concat('{{"root_cause": "', m[1:8], '", "confidence": 0.5}}') END AS raw_content,
  CASE WHEN m[1] = '0' THEN 'no answer after 3 attempts' END AS error, {s.lit(fv.MODEL_NAME)} AS model_used,
  CAST(CASE WHEN m[1] = '0' THEN 0 ELSE strlen(user_prompt) // 3 END AS INT) AS total_tokens FROM h""",
    "diagnose_batch": _W(*_DIAGNOSED) + f"""SELECT log_id AS query_id, original_hash, status, strategy, rag_missed,
  CAST(n_hits AS INT) AS n_hits, retrieved_doc_ids,
  CASE WHEN raw_content IS NULL THEN '' ELSE root_cause END AS root_cause,
  md5(analysis_process) AS analysis_md5,
  array_to_string(solution_steps, '|') AS steps, round(confidence, 6) AS confidence, error,
  CAST(total_tokens AS INT) AS total_tokens, CAST(latency_ms AS BIGINT) AS latency_ms, CAST(NULL AS BIGINT) AS history_id
FROM done
UNION ALL SELECT p.log_id, original_hash, 'cache', m.strategy, NULL, NULL, NULL, {s.fault('p.log_id')}, md5(''), 'restart', 0.25,
  NULL, NULL, NULL, p.log_id FROM prep p JOIN meta m ON m.log_id = p.log_id WHERE ts < TIMESTAMP '{FIRST_WEEK_END}'""",
    "diagnose_bad_answers": _W(*_DIAGNOSED)
    + f"SELECT log_id AS query_id, raw_content, {_KEYS} AS parsed_keys FROM done WHERE status = 'bad'",
    "auto_learn": _W(*_DIAGNOSED, "kb_state AS (SELECT kb.*, e.embedding FROM kb LEFT JOIN embeddings e ON e.vec_id = kb.id)", *_LEARNED)
    + _state("kb_state") + " UNION ALL " + _state("fresh", f"'{NOW}'"),
    "diagnose_articles": _W(*_DIAGNOSED, _embedded("kb", "kb_now"), *_LEARNED, *_SERVICE_VECTORS)
    + _state("kb_now") + " UNION ALL " + _state("served", f"'{NOW}'"),
    "diagnose_history": _W(*_DIAGNOSED) + f"""SELECT (SELECT max(log_id) FROM logs WHERE ts < TIMESTAMP '{FIRST_WEEK_END}')
    + row_number() OVER (ORDER BY md5(CAST(log_id AS VARCHAR))) AS id,
  substr(sha256(concat_ws('|', original_hash, strategy, concat('r1-', log_id))), 1, 36) AS session_id, original_hash AS log_hash,
  md5({s.clip('short', fv.SNIPPET_CHARS)}) AS snippet_md5, coalesce(retrieved_doc_ids, '') AS retrieved_doc_ids, root_cause,
  md5(analysis_process) AS analysis_md5, array_to_string(solution_steps, '|') AS steps, round(confidence, 6) AS confidence,
  {s.lit(fv.MODEL_NAME)} AS model_used, strategy AS prompt_strategy, CAST(total_tokens AS BIGINT) AS total_tokens,
  CAST(latency_ms AS BIGINT) AS latency_ms, '{NOW}' AS created FROM done WHERE status = 'ok'""",

    "recorded_answers": _W(*_DIRECT, _TURNS) + "SELECT log_id AS query_id, md5(" + _turn_sql("log_id") + """) AS raw_md5,
  CASE WHEN turns IS NULL THEN 'no recorded answer' END AS error,
  CAST(CASE WHEN turns IS NULL THEN 0 ELSE strlen(user_prompt) // 3 END AS INT) AS total_tokens,
  CAST(CASE WHEN turns IS NULL THEN 0 ELSE log_id // 4 + 1000 END AS BIGINT) AS latency_ms
FROM prompts p LEFT JOIN turns f ON f.conv_id = p.log_id // 4""",
}
ORACLE["llm_answers_kept"] = ORACLE["llm_answers"]
