"""From retrieved articles to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultlens.functions.prompts import EXPECTED_FORMAT, SYSTEM_PROMPT, article_block, user_prompt


def miss_to_cot(logs: DataFrame) -> DataFrame:
    """Logs with use_rag, n_hits and strategy: a search without hits switches to COT. Adds rag_missed."""
    missed = F.col("use_rag") & (F.coalesce(F.col("n_hits"), F.lit(0)) == 0)
    return logs.withColumn("rag_missed", missed).withColumn(
        "strategy", F.when(F.col("rag_missed"), "COT").otherwise(F.col("strategy"))
    )


def pack_articles(hits: DataFrame, kb: DataFrame) -> DataFrame:
    """(query_id, articles): the few final hits of a log in rank order, with title and content."""
    full = hits.join(kb.select("id", "title", "content"), "id")
    packed = F.array_sort(F.collect_list(F.struct("hit_rank", "id", "title", "content")))
    return full.groupBy("query_id").agg(packed.alias("articles"))


def assemble_prompt(logs: DataFrame) -> DataFrame:
    """Adds system_prompt, user_prompt, full_prompt and expected_format.

    logs need strategy, processed_text and articles (null or empty without hits).
    """
    return (
        logs.withColumn(
            "user_prompt",
            user_prompt(F.col("strategy"), F.col("processed_text"), article_block(F.col("articles"))),
        )
        .withColumn("system_prompt", F.lit(SYSTEM_PROMPT))
        .withColumn("full_prompt", F.col("user_prompt"))
        .withColumn("expected_format", F.lit(EXPECTED_FORMAT))
    )
