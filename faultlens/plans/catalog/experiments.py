"""Cases, result files, scoring and the experiment grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import whole_div
from faultlens.operators import evaluation as ev
from faultlens.operators.hybrid import hybrid_search
from faultlens.plans.catalog import sql as s
from faultlens.plans.catalog.answering import _TURNS, _answerer, _turn_sql
from faultlens.plans.catalog.searching import kb_embedded, prepared, vectors_with_failures
from faultlens.plans.experiment import KEY, run_experiment
from faultlens.session import work_path
from faultlens.sources import files, views
from faultlens.sources.stage import stage

_ROUNDED = {"accuracy": 6, "avg_confidence": 6, "avg_knowledge": 6}


def _rounded(df):
    for name in df.columns:
        if any(name.endswith(r) for r in [*_ROUNDED, "accuracy_delta"]):
            df = df.withColumn(name, F.round(name, 6))
    return df


def src_cases_json(spark, d):
    path = work_path(spark, "cases")
    views.cases(spark, d).write.json(path)
    return files.read_cases(spark, path, lines=True).withColumn("expected_keywords", F.array_join("expected_keywords", "|"))


def case_summaries(spark, d):
    rows, total = ev.case_summaries(views.cases(spark, d))
    return rows.unionByName(total.select(F.lit("total").alias("id"), F.lit("").alias("category"), F.col("total").cast("string").alias("log_snippet")))


def sink_results_csv(spark, d):
    path = work_path(spark, "results-csv")
    files.write_results_csv(views.results(spark, d), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


def src_results_csv(spark, d):
    path = work_path(spark, "results-csv")
    files.write_results_csv(views.results(spark, d), path)
    back = files.read_results(spark, path)
    return back.groupBy("strategy", "mode", "is_correct").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_ms"), F.round(F.sum("confidence"), 4).alias("confidence"),
        F.sum("knowledge_used").alias("knowledge_used"), F.min("predicted_cause").alias("first_cause"),
    )


def sink_results_json(spark, d):
    path = work_path(spark, "results-json")
    files.write_results_json(views.results(spark, d), path)
    back = files.read_results_json(spark, path)
    return back.select("case_id", "category", "log_snippet", "predicted_cause", "is_correct", F.round("confidence", 6).alias("confidence"), "error")


def is_correct(spark, d):
    event_id, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    words = F.array(views.fault(event_id + 5), views.fault(k), views.fault(event_id), views.fault(event_id + 17))
    rows = views.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("Cause: "), views.fault(event_id), F.lit(" after "), F.col("event_type")).alias("predicted"),
        F.concat(F.lit("the "), views.fault(event_id + k), F.lit("　and "), F.lower(views.fault(event_id + 1))).alias("expected"),
        F.slice(words, F.lit(1), (event_id % 5).cast("int")).alias("words"),
    )
    return ev.is_correct(rows, "predicted", "expected", "words").select("event_id", "is_correct")


def case_grid(spark, d):
    return ev.case_grid(views.cases(spark, d).select("id", "category")).select("id", "category", "strategy", "mode")


def first_n_cases(spark, d):
    return ev.first_n_cases(views.cases(spark, d), 10).select("id", "category")


def category_count(spark, d):
    return ev.category_count(views.cases(spark, d))


def accuracy_overall(spark, d):
    return _rounded(ev.accuracy_overall(views.results(spark, d)))


def accuracy_by_strategy(spark, d):
    return _rounded(ev.accuracy_by_strategy(views.results(spark, d)))


def accuracy_by_category(spark, d):
    return _rounded(ev.accuracy_by_category(views.results(spark, d)))


def mode_comparison(spark, d):
    return _rounded(ev.mode_comparison(views.results(spark, d)))


def best_strategy(spark, d):
    return _rounded(ev.best_strategy(views.results(spark, d)))


def run_status(spark, d):
    return ev.run_status(views.results(spark, d))


def _case_hits(spark, d):
    logs = prepared(spark, d)
    kb = kb_embedded(spark, d)
    hits = hybrid_search(logs, kb, embed=vectors_with_failures)
    return ev.case_hits(logs.select(F.col("query_id").alias("case_id")), hits, kb)


def hit_rate_cases(spark, d):
    return _case_hits(spark, d)


def hit_rate(spark, d):
    return _rounded(ev.hit_rate(_case_hits(spark, d))).withColumn("hit_rate", F.round("hit_rate", 6))


def hit_rate_grade(spark, d):
    group = (F.col("case_id") % 10).alias("case_group")
    per = _case_hits(spark, d).groupBy(group).agg((F.count_if(F.col("n_hits") > 0) / F.count(F.lit(1)) * 100).alias("rate"))
    return per.select("case_group", F.round("rate", 6).alias("hit_rate"), ev.hit_rate_grade(F.col("rate")).alias("grade"))


def _grid(spark, d):
    number = F.substring("case_id", 6, 12).cast("long")
    shift = F.when(F.col("strategy") == "ZERO_SHOT", 0).when(F.col("strategy") == "FEW_SHOT", 7).otherwise(14)
    shift = shift + F.when(F.col("mode") == "RAG", 0).otherwise(3)
    answer = _answerer(spark, d, KEY, lambda: whole_div(number, 4) + shift, lambda: number)
    return stage(run_experiment(views.cases(spark, d), kb_embedded(spark, d), answer), "grid")


def run_experiment_query(spark, d):
    return _grid(spark, d).withColumn("confidence", F.round("confidence", 6))


def experiment_report(spark, d):
    return _rounded(ev.mode_comparison(_grid(spark, d)))


QUERIES = {
    "src_cases_json": src_cases_json,
    "case_summaries": case_summaries,
    "sink_results_csv": sink_results_csv,
    "src_results_csv": src_results_csv,
    "sink_results_json": sink_results_json,
    "is_correct": is_correct,
    "case_grid": case_grid,
    "first_n_cases": first_n_cases,
    "category_count": category_count,
    "accuracy_overall": accuracy_overall,
    "accuracy_by_strategy": accuracy_by_strategy,
    "accuracy_by_category": accuracy_by_category,
    "mode_comparison": mode_comparison,
    "best_strategy": best_strategy,
    "run_status": run_status,
    "hit_rate_cases": hit_rate_cases,
    "hit_rate": hit_rate,
    "hit_rate_grade": hit_rate_grade,
    "run_experiment": run_experiment_query,
    "experiment_report": experiment_report,
}

_W = s.with_


def _figures(ok=None):
    pairs = s.figures(ok) if ok else s.figures()
    return [(n, f"round({e}, 6)" if n in _ROUNDED else f"CAST({e} AS BIGINT)") for n, e in pairs]


def _select(pairs):
    return ", ".join(f"{e} AS {n}" for n, e in pairs)


def _comparison(source):
    columns = []
    raw = {}
    for mode in fv.MODES:
        for name, e in s.figures(f"coalesce(error, '') = '' AND mode = '{mode}'")[:5]:
            raw[f"{mode.lower()}_{name}"] = e
            columns.append(f"{e} AS {mode.lower()}_{name}")
    inner = ", ".join(columns)
    out = ", ".join(f"round({c}, 6) AS {c}" if "accuracy" in c or "confidence" in c else f"CAST({c} AS BIGINT) AS {c}" for c in raw)
    return f"""
SELECT strategy, {out}, round(rag_accuracy - direct_accuracy, 6) AS accuracy_delta,
  CAST(direct_avg_latency_ms - rag_avg_latency_ms AS BIGINT) AS latency_delta_ms
FROM (
  SELECT strategy, {inner} FROM {source} WHERE strategy IN ('ZERO_SHOT', 'FEW_SHOT', 'COT') GROUP BY strategy
  UNION ALL SELECT 'ALL', {inner} FROM {source})"""


_CSV = ", ".join(
    f"format('{{:.4f}}', {c}) AS {c}" if c == "confidence" else f"CAST({c} AS VARCHAR) AS {c}" for c in fv.RESULT_CSV_COLUMNS
)
_CASE_HITS = [s.LOGS, s.KB, s.prepared(), s.hits(embedded=s.EMBEDDED), s.FUSED, s.ranked(), """
case_hits AS (
  SELECT p.log_id AS case_id, coalesce(n, 0) AS n_hits, top_title
  FROM prep p LEFT JOIN (
    SELECT qid, count(*) AS n, arg_min(title, hit_rank) AS top_title FROM final JOIN kb ON kb.id = final.id GROUP BY qid) t
    ON t.qid = p.log_id)"""]
_GRID = [s.CASES, s.KB, s.prepared("cases", "id", "log"), s.hits(key="id"), s.FUSED, s.ranked(), s.PACKED, _TURNS, f"""
grid AS (
  SELECT c.*, p.short, st.strategy, mo.mode, CASE WHEN mode = 'RAG' THEN coalesce(k.n_hits, 0) ELSE 0 END AS knowledge_used,
    CASE WHEN mode = 'RAG' THEN k.block END AS block,
    log_id // 4 + CASE st.strategy WHEN 'ZERO_SHOT' THEN 0 WHEN 'FEW_SHOT' THEN 7 ELSE 14 END
      + CASE mode WHEN 'RAG' THEN 0 ELSE 3 END AS conv
  FROM cases c JOIN prep p ON p.id = c.id LEFT JOIN packed k ON k.qid = c.id
  CROSS JOIN (SELECT unnest({s.arr(fv.STRATEGIES)}) AS strategy) st CROSS JOIN (SELECT unnest({s.arr(fv.MODES)}) AS mode) mo),
asked AS (
  SELECT g.*, {_turn_sql('log_id')} AS raw_content, strlen({s.prompt('g.strategy', 'g.short', 'g.block')}) // 3 AS n_tokens
  FROM grid g LEFT JOIN turns f ON f.conv_id = g.conv)""", s.parsed("asked", "raw_content"), r"""
judged AS (
  SELECT *, raw_content IS NOT NULL AS answered,
    len(list_filter(expected_keywords, lambda w: contains(lower(root_cause), lower(w)))) >= len(expected_keywords) // 2
    OR len(list_filter(string_split_regex(lower(expected_root_cause), '[\t-\r \x{85}\p{Z}]+'),
      lambda w: strlen(w) > 3 AND contains(lower(root_cause), w))) > 0 AS hit
  FROM read),
results AS (
  SELECT id AS case_id, category, """ + s.clip_bytes("log", fv.CASE_SNIPPET_BYTES) + r""" AS log_snippet, mode, strategy,
    CASE WHEN answered THEN root_cause ELSE '' END AS predicted_cause, expected_root_cause AS expected_cause,
    answered AND hit AS is_correct, CASE WHEN answered THEN round(confidence, 6) ELSE 0.0 END AS confidence,
    CAST(conv + 1000 AS BIGINT) AS latency_ms, CAST(knowledge_used AS INT) AS knowledge_used,
    CAST(CASE WHEN answered THEN n_tokens ELSE 0 END AS INT) AS tokens_used,
    CASE WHEN answered THEN '' ELSE 'no answer' END AS error FROM judged)"""]

ORACLE = {
    "src_cases_json": _W(s.CASES) + """SELECT id, category, log, expected_root_cause,
  array_to_string(expected_keywords, '|') AS expected_keywords FROM cases""",
    "case_summaries": _W(s.CASES) + f"""SELECT id, category, {s.clip_bytes('log', fv.CASE_SNIPPET_BYTES)} AS log_snippet FROM cases
UNION ALL SELECT 'total', '', CAST(count(*) AS VARCHAR) FROM cases""",
    "sink_results_csv": _W(s.RESULTS) + f"SELECT {_CSV} FROM results",
    "src_results_csv": _W(s.RESULTS) + """SELECT strategy, mode, is_correct, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
  round(sum(CAST(format('{:.4f}', confidence) AS DOUBLE)), 4) AS confidence, CAST(sum(knowledge_used) AS BIGINT) AS knowledge_used,
  min(predicted_cause) AS first_cause FROM results GROUP BY ALL""",
    "sink_results_json": _W(s.RESULTS) + """SELECT case_id, category, log_snippet, predicted_cause, is_correct,
  round(confidence, 6) AS confidence, nullif(error, '') AS error FROM results""",
    "is_correct": r"WITH r AS (SELECT event_id, concat('Cause: ', " + s.fault("event_id") + r""", ' after ', event_type) AS predicted,
  concat('the ', """ + s.fault("event_id + k") + r""", chr(12288), 'and ', lower(""" + s.fault("event_id + 1") + r""")) AS expected,
  ([""" + ", ".join(s.fault(x) for x in ["event_id + 5", "k", "event_id", "event_id + 17"]) + r"""])[1:CAST(event_id % 5 AS INT)] AS words
  FROM (SELECT *, """ + s._K + r""" AS k FROM events))
SELECT event_id, len(list_filter(words, lambda w: contains(lower(predicted), lower(w)))) >= len(words) // 2
  OR len(list_filter(string_split_regex(lower(expected), '[\t-\r \x{85}\p{Z}]+'),
    lambda w: strlen(w) > 3 AND contains(lower(predicted), w))) > 0 AS is_correct FROM r""",
    "case_grid": _W(s.CASES) + f"""SELECT id, category, strategy, mode FROM cases, (SELECT unnest({s.arr(fv.STRATEGIES)}) AS strategy),
  (SELECT unnest({s.arr(fv.MODES)}) AS mode)""",
    "first_n_cases": _W(s.CASES) + "SELECT id, category FROM cases ORDER BY id LIMIT 10",
    "category_count": _W(s.CASES) + "SELECT count(DISTINCT category) AS n_categories FROM cases",
    "accuracy_overall": _W(s.RESULTS) + f"SELECT {_select(_figures())} FROM results",
    "accuracy_by_strategy": _W(s.RESULTS)
    + f"SELECT strategy, {_select(_figures())} FROM results WHERE strategy IN ('ZERO_SHOT', 'FEW_SHOT', 'COT') GROUP BY strategy",
    "accuracy_by_category": _W(s.RESULTS) + f"SELECT category, {_select(_figures())} FROM results GROUP BY category",
    "mode_comparison": _W(s.RESULTS) + _comparison("results"),
    "best_strategy": _W(s.RESULTS, f"""
per AS (SELECT strategy, {dict(s.figures())['accuracy']} AS acc FROM results WHERE mode = 'RAG' GROUP BY strategy)""")
    + f"""SELECT coalesce((SELECT strategy FROM per WHERE acc > 0 AND strategy <> 'OTHER'
    ORDER BY acc DESC, list_position({s.arr(fv.STRATEGIES)}, strategy) LIMIT 1), 'ZERO_SHOT') AS best_strategy,
  coalesce((SELECT round(max(acc), 6) FROM per WHERE strategy <> 'OTHER'), 0.0) AS best_accuracy""",
    "run_status": _W(s.RESULTS) + """SELECT CASE WHEN error <> '' THEN 'err' WHEN NOT is_correct THEN 'fail' ELSE 'ok' END AS status,
  count(*) AS n_runs FROM results GROUP BY 1""",
    "hit_rate_cases": _W(*_CASE_HITS) + "SELECT case_id, n_hits, top_title FROM case_hits",
    "hit_rate": _W(*_CASE_HITS) + """SELECT count(*) AS n_cases, count(*) FILTER (n_hits > 0) AS n_hit,
  round(count(*) FILTER (n_hits > 0)::DOUBLE / count(*) * 100, 6) AS hit_rate FROM case_hits""",
    "hit_rate_grade": _W(*_CASE_HITS) + """SELECT case_group, round(rate, 6) AS hit_rate,
  CASE WHEN rate >= 80 THEN 'good' WHEN rate >= 50 THEN 'low' ELSE 'bad' END AS grade
FROM (SELECT case_id % 10 AS case_group, count(*) FILTER (n_hits > 0)::DOUBLE / count(*) * 100 AS rate FROM case_hits GROUP BY 1)""",
    "run_experiment": _W(*_GRID) + "SELECT * FROM results",
    "experiment_report": _W(*_GRID) + _comparison("results"),
}
