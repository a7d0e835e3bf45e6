"""Scoring of experiment runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import clip_bytes, fold_lower, whole_div

WHITE_SPACE = r"[\t-\r \x{85}\p{Z}]+"


def is_correct(df: DataFrame, predicted: str, expected: str, keywords: str, out: str = "is_correct") -> DataFrame:
    """At least half the keywords (rounded down) occur in the prediction, or any word of the expected cause
    longer than three bytes does; case is ignored."""
    low = df.withColumn("_said", fold_lower(F.coalesce(predicted, F.lit(""))))
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.col("_said"), fold_lower(k))))
    half = whole_div(F.size(keywords), 2)
    shared = F.exists(
        F.split(fold_lower(F.col(expected)), WHITE_SPACE),
        lambda w: (F.octet_length(w) > 3) & F.contains(F.col("_said"), w),
    )
    return low.withColumn(out, (hits >= half) | shared).drop("_said")


def case_grid(cases: DataFrame, strategies: list[str] | None = None, modes: list[str] | None = None) -> DataFrame:
    """Every case once per strategy and mode."""
    strategies, modes = strategies or fv.STRATEGIES, modes or fv.MODES
    return cases.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies]))).withColumn(
        "mode", F.explode(F.array(*[F.lit(m) for m in modes]))
    )


def experiment_strategies(name: str | None) -> list[str]:
    """Strategies of a run request: all for ALL or nothing, else the one named."""
    wanted = (name or "ALL").upper()
    if wanted == "ALL":
        return list(fv.STRATEGIES)
    if wanted not in fv.STRATEGIES:
        raise ValueError(f"unsupported strategy: {name}")
    return [wanted]


def first_n_cases(cases: DataFrame, n: int) -> DataFrame:
    return cases.orderBy("id").limit(n) if n > 0 else cases


def case_summaries(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, category and start of the log per case, one-row total)."""
    rows = cases.select("id", "category", clip_bytes(F.col("log"), fv.CASE_SNIPPET_BYTES).alias("log_snippet"))
    return rows, cases.agg(F.count(F.lit(1)).alias("total"))


def category_count(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_distinct("category").alias("n_categories"))


def _figures(ok: Column | None = None) -> list[Column]:
    """Counts and means over rows without error; integer means are cut off, empty sets give zeros."""
    ok = F.coalesce("error", F.lit("")) == "" if ok is None else ok
    total = F.count_if(ok)

    def total_of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0))

    def mean_of(name: str) -> Column:
        # a sum of decimals is the same in any order of the rows; what is no such number adds nothing
        exact = F.sum(F.when(ok, F.col(name).try_cast("decimal(28,12)")))
        return F.coalesce(F.try_divide(exact.cast("double"), total.cast("double")), F.lit(0.0))

    def whole_mean_of(name: str) -> Column:
        return F.coalesce(F.call_function("div", total_of(name), F.nullif(total, F.lit(0))), F.lit(0))

    correct = F.count_if(ok & F.col("is_correct"))
    return [
        total.alias("total"),
        correct.alias("correct"),
        F.coalesce(F.try_divide(correct.cast("double"), total.cast("double")) * 100, F.lit(0.0)).alias("accuracy"),
        whole_mean_of("latency_ms").alias("avg_latency_ms"),
        mean_of("confidence").alias("avg_confidence"),
        whole_mean_of("tokens_used").alias("avg_tokens"),
        mean_of("knowledge_used").alias("avg_knowledge"),
    ]


def accuracy_overall(results: DataFrame) -> DataFrame:
    return results.agg(*_figures())


def accuracy_by_strategy(results: DataFrame) -> DataFrame:
    return results.filter(F.col("strategy").isin(*fv.STRATEGIES)).groupBy("strategy").agg(*_figures())


def accuracy_by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(*_figures())


def mode_comparison(results: DataFrame) -> DataFrame:
    """RAG against DIRECT, per known strategy and over all rows (strategy ALL), in one pass."""
    blank = F.coalesce("error", F.lit("")) == ""
    known = F.when(F.col("strategy").isin(*fv.STRATEGIES), F.col("strategy")).otherwise("OTHER")
    columns = []
    for mode in fv.MODES:
        named = _figures(blank & (F.col("mode") == mode))
        for column, name in zip(named, ["total", "correct", "accuracy", "avg_latency_ms", "avg_confidence"]):
            columns.append(column.alias(f"{mode.lower()}_{name}"))
    per = results.withColumn("strategy", known).rollup("strategy").agg(*columns)
    return (
        per.filter(F.col("strategy").isNull() | (F.col("strategy") != "OTHER"))
        .withColumn("strategy", F.coalesce("strategy", F.lit("ALL")))
        .withColumn("accuracy_delta", F.col("rag_accuracy") - F.col("direct_accuracy"))
        .withColumn("latency_delta_ms", F.col("direct_avg_latency_ms") - F.col("rag_avg_latency_ms"))
    )


def best_strategy(results: DataFrame) -> DataFrame:
    """Strategy with the highest RAG accuracy; the first in fixed order wins ties and empty sets."""
    per = accuracy_by_strategy(results.filter(F.col("mode") == "RAG"))
    order = F.array_position(F.array(*[F.lit(s) for s in fv.STRATEGIES]), F.col("strategy"))
    best = per.filter(F.col("accuracy") > 0).agg(
        F.max_by("strategy", F.struct("accuracy", -order)).alias("best"), F.max("accuracy").alias("top")
    )
    return best.select(
        F.coalesce("best", F.lit(fv.STRATEGIES[0])).alias("best_strategy"),
        F.coalesce("top", F.lit(0.0)).alias("best_accuracy"),
    )


def case_hits(cases: DataFrame, hits: DataFrame, kb: DataFrame) -> DataFrame:
    """(case_id, n_hits, top_title) for every case; cases(case_id), hits(query_id = case_id, hit_rank, id)."""
    titled = hits.join(kb.select("id", "title"), "id")
    per = titled.groupBy(F.col("query_id").alias("case_id")).agg(
        F.count(F.lit(1)).alias("n_hits"), F.min_by("title", "hit_rank").alias("top_title")
    )
    return cases.select("case_id").join(per, "case_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def hit_rate(per_case: DataFrame) -> DataFrame:
    rate = F.coalesce(
        F.try_divide(F.count_if(F.col("n_hits") > 0).cast("double"), F.count(F.lit(1)).cast("double")) * 100, F.lit(0.0)
    )
    return per_case.agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("n_hits") > 0).alias("n_hit"), rate.alias("hit_rate")
    )


def hit_rate_grade(rate: Column) -> Column:
    return F.when(rate >= 80, "good").when(rate >= 50, "low").otherwise("bad")


def run_status(results: DataFrame) -> DataFrame:
    """Runs per status: err, fail or ok."""
    status = (
        F.when(F.coalesce("error", F.lit("")) != "", "err").when(~F.col("is_correct"), "fail").otherwise("ok")
    )
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_runs"))
