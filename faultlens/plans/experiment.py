"""Evaluation of a whole grid of cases, strategies and modes in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.answers import answer_fields, parse_answers
from faultlens.functions.text import clip_bytes
from faultlens.operators.embedding import hashed_vectors
from faultlens.operators.evaluation import case_grid, is_correct
from faultlens.operators.hybrid import hybrid_search, retrieved_ids
from faultlens.operators.prompting import assemble_prompt, pack_articles
from faultlens.plans.diagnose import Answerer, prepare_logs
from faultlens.sources.stage import stage

KEY = ["case_id", "strategy", "mode"]


def run_experiment(
    cases: DataFrame,
    kb: DataFrame,
    answer: Answerer,
    strategies: list[str] | None = None,
    modes: list[str] | None = None,
    k: int = fv.TOP_K,
    threshold: float = fv.SCORE_THRESHOLD,
    method: str = "fused",
    embed=hashed_vectors,
) -> DataFrame:
    """One result row per case, strategy and mode.

    Preprocessing and search run once per case, before the grid multiplies the rows. ``answer`` gets prompts
    with the key columns case_id, strategy and mode and returns them with the answer.
    """
    plain = cases.select(
        F.col("id").alias("query_id"), F.col("id").alias("case_id"), "category", "log",
        "expected_root_cause", "expected_keywords",
        clip_bytes(F.col("log"), fv.CASE_SNIPPET_BYTES).alias("log_snippet"),
    )
    prepared = prepare_logs(plain, text="log")
    hits = stage(
        hybrid_search(prepared.select("query_id", "keywords", "processed_text"), kb, k, threshold, method, embed),
        "case_hits",
    )
    found = prepared.join(retrieved_ids(hits), "query_id", "left").join(pack_articles(hits, kb), "query_id", "left")

    rag = F.col("mode") == "RAG"
    grid = (
        case_grid(found, strategies, modes)
        .withColumn("articles", F.when(rag, F.col("articles")))
        .withColumn("knowledge_used", F.when(rag, F.coalesce("n_hits", F.lit(0))).otherwise(0))
    )
    prompts = assemble_prompt(grid).select(*KEY, "system_prompt", "user_prompt")
    answers = stage(answer(prompts), "grid_answers")

    context = case_grid(
        found.select("case_id", "category", "log_snippet", "expected_root_cause", "expected_keywords", "n_hits"),
        strategies, modes,
    ).withColumn("knowledge_used", F.when(rag, F.coalesce("n_hits", F.lit(0))).otherwise(0))
    read = answer_fields(parse_answers(context.join(answers, KEY)))
    answered = F.col("error").isNull()
    scored = is_correct(
        read.withColumn("predicted_cause", F.when(answered, F.col("root_cause")).otherwise("")),
        "predicted_cause", "expected_root_cause", "expected_keywords",
    )
    return scored.select(
        "case_id", "category", "log_snippet", "mode", "strategy", "predicted_cause",
        F.col("expected_root_cause").alias("expected_cause"),
        (answered & F.col("is_correct")).alias("is_correct"),
        F.when(answered, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.col("latency_ms").cast("long").alias("latency_ms"),
        F.col("knowledge_used").cast("int").alias("knowledge_used"),
        F.when(answered, F.col("total_tokens")).otherwise(0).cast("int").alias("tokens_used"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
