"""Diagnosis of a whole table of logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.answers import answer_fields, parse_answers
from faultlens.functions.prompts import pick_strategy
from faultlens.operators.embedding import hashed_vectors
from faultlens.operators.history import hash_lookup, history_rows, lookup_within, stable_session_id
from faultlens.operators.hybrid import hybrid_search, retrieved_ids
from faultlens.operators.knowledge import auto_learn, number_rows
from faultlens.operators.postings import SearchIndex
from faultlens.operators.preprocess import preprocess, with_keywords
from faultlens.operators.prompting import assemble_prompt, miss_to_cot, pack_articles
from faultlens.sources.stage import stage

# prompts(query_id, system_prompt, user_prompt, ...) ->
#   (query_id, raw_content, error, model_used, total_tokens, latency_ms)
Answerer = Callable[[DataFrame], DataFrame]


def prepare_logs(logs: DataFrame, text: str = "content", max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """Preprocessed logs with search keywords, written once because every later step reads them."""
    return stage(with_keywords(preprocess(logs, text, max_tokens)), "prepared")


def build_prompts(
    logs: DataFrame,
    kb: DataFrame,
    k: int = fv.TOP_K,
    threshold: float = fv.SCORE_THRESHOLD,
    method: str = "fused",
    embed=hashed_vectors,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Prepared logs(query_id, strategy, use_rag, processed_text, keywords) with hits and prompts."""
    asked = logs.filter("use_rag").select("query_id", "keywords", "processed_text")
    hits = stage(hybrid_search(asked, kb, k, threshold, method, embed, index=index), "hits")
    with_hits = logs.join(retrieved_ids(hits), "query_id", "left").join(pack_articles(hits, kb), "query_id", "left")
    chosen = miss_to_cot(with_hits.withColumn("strategy", pick_strategy(F.col("strategy"))))
    return assemble_prompt(chosen.withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))).drop("articles")


def diagnose_batch(
    logs: DataFrame,
    kb: DataFrame,
    history: DataFrame,
    answer: Answerer,
    text: str = "content",
    max_tokens: int = fv.MAX_TOKENS,
    method: str = "fused",
    embed=hashed_vectors,
    cache_hours: int | None = None,
    index: SearchIndex | None = None,
) -> DataFrame:
    """logs(query_id, content, strategy, use_rag) -> one row per log with its outcome.

    With ``cache_hours`` only diagnoses so many hours before a log's ``ts`` answer it (history with ``created_at``). Logs with equal
    prompts cost one request if ``answer`` asks by prompt (``answers_kept``). ``index`` holds the articles' words.

    ``status`` is cache (same text diagnosed before), ok, bad (no root cause in the answer) or error (no
    answer). Rows with status ok feed ``history_rows`` and ``articles_from_diagnoses``. The answers are
    written before anything reads them, so no model is asked twice.
    """
    ready = prepare_logs(logs, text, max_tokens)
    looked_up = hash_lookup(ready, history) if cache_hours is None else lookup_within(ready, history, cache_hours)
    prepared = stage(looked_up, "looked_up")
    fresh = prepared.filter("history_id IS NULL").drop("history_id", "cached_result")
    prompts = stage(build_prompts(fresh, kb, method=method, embed=embed, index=index), "prompts")
    answers = stage(answer(prompts), "answers")

    context = prompts.select(
        "query_id", "original_hash", "processed_text", "key_errors", "strategy", "use_rag", "rag_missed",
        "n_hits", "retrieved_doc_ids",
    )
    read = answer_fields(parse_answers(context.join(answers, "query_id"), "raw_content"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("root_cause") == "", "bad").otherwise("ok")
    done = read.withColumn("status", status).drop("parsed")

    repeated = prepared.filter("history_id IS NOT NULL")
    cached = repeated.select(
        "query_id", "original_hash", "processed_text", "key_errors", "strategy", "use_rag",
        "history_id", F.col("cached_result.*"), F.lit("cache").alias("status"),
    )
    return done.unionByName(cached, allowMissingColumns=True)


def diagnose_and_store(
    logs: DataFrame,
    kb: DataFrame,
    history: DataFrame,
    answer: Answerer,
    out: str,
    run: str,
    now: Column | None = None,
    **options,
) -> dict[str, DataFrame]:
    """``diagnose_batch`` and what follows from it, written below ``out``: outcome, history, articles.

    History are the new rows, numbered after the last id: diagnoses with status ok. Articles are the new state of the
    whole table, with those learned from searches without hits. Every run has its own folders; a repeated run
    overwrites its own and reads kb and history as they were, so nothing is stored or learned twice.
    """
    spark = logs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = f"{out.rstrip('/')}/{name}/run={run}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    outcome = written(diagnose_batch(logs, kb, history, answer, **options), "outcome")
    good = outcome.filter("status = 'ok'")
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last_id"))
    session = stable_session_id(F.col("original_hash"), F.col("strategy"), F.concat_ws("-", F.lit(run), "query_id"))
    rows = history_rows(good, session, now, "query_id").join(number_rows(good.select("query_id"), last), "query_id")
    return {
        "outcome": outcome,
        "history": written(rows.drop("query_id"), "history"),
        "articles": written(auto_learn(kb, good, options.get("embed", hashed_vectors), now), "articles"),
    }


def bad_answers(diagnosed: DataFrame) -> DataFrame:
    """The error output: raw text and the top-level keys of answers without a root cause."""
    from faultlens.functions.answers import parsed_keys

    bad = diagnosed.filter(F.col("status") == "bad").select("query_id", "raw_content")
    return parse_answers(bad).select("query_id", "raw_content", parsed_keys(F.col("parsed")).alias("parsed_keys"))
