"""Scoring rules, files and reports."""

import json

import pytest
from pyspark.sql import functions as F

from faultlens.operators import evaluation as ev
from faultlens.sources import files, schemas

RESULTS = f"{schemas.RESULTS_CSV}, log_snippet string, error string"


def result(strategy="COT", mode="RAG", ok=True, error="", latency=10, tokens=3, confidence=0.5, knowledge=1, category="c"):
    return ("case", category, mode, strategy, 'p, "q"', "e", ok, confidence, latency, knowledge, tokens, "snippet", error)


def frame(spark, rows):
    return spark.createDataFrame(rows, RESULTS)


def judge(spark, said, expected, words):
    df = spark.createDataFrame([(said, expected, words)], "p string, e string, k array<string>")
    return ev.is_correct(df, "p", "e", "k").first().is_correct


def test_is_correct(spark):
    assert judge(spark, "", "", []) and judge(spark, "", "", ["x"])
    five = ["aa", "bb", "cc", "dd", "ee"]
    assert not judge(spark, "AA", "", five) and judge(spark, "AA Bb", "", five)
    assert not judge(spark, "the cat", "cat", five) and judge(spark, "the cats", "cats", five)
    assert not judge(spark, "内", "内", five) and judge(spark, "内存", "内存", five)
    assert judge(spark, "full disk", "x　DISK", five) and judge(spark, "full disk", "x\x0bdisk\x85y", five)
    assert not judge(spark, None, "disk", five)


def test_accuracy(spark):
    rows = [result(latency=10, tokens=3), result(latency=11, tokens=4, ok=False), result(error="x", latency=999)]
    got = ev.accuracy_overall(frame(spark, rows)).first().asDict()
    assert got == {"total": 2, "correct": 1, "accuracy": 50.0, "avg_latency_ms": 10, "avg_confidence": 0.5, "avg_tokens": 3, "avg_knowledge": 1.0}
    empty = ev.accuracy_overall(frame(spark, [result(error="x")])).first().asDict()
    assert set(empty.values()) == {0}
    by = ev.accuracy_by_strategy(frame(spark, rows + [result("OTHER"), result("FEW_SHOT", error="x")]))
    assert {r.strategy: r.total for r in by.collect()} == {"COT": 2, "FEW_SHOT": 0}


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """352 confidences that sum to 173.03: their mean ends exactly on half a unit of the sixth digit."""
    values = [0.49] * 351 + [173.03 - 351 * 0.49]
    rows = [("c", "RAG", "COT", True, v, 10, 1, 1, "") for v in values]
    schema = "category string, mode string, strategy string, is_correct boolean, confidence double, latency_ms long, tokens_used int, knowledge_used int, error string"
    means = set()
    for order in (rows, rows[::-1], rows[100:] + rows[:100]):
        for parts in (1, 3, 8):
            means.add(ev.accuracy_overall(spark.createDataFrame(order, schema).repartition(parts)).first().avg_confidence)
    assert means == {0.4915625}
    odd = spark.createDataFrame([(*rows[0][:4], v, *rows[0][5:]) for v in (0.5, float("nan"), None, 1e300)], schema)
    assert ev.accuracy_overall(odd).first().avg_confidence == 0.125


def test_mode_comparison(spark):
    rows = [result(mode="RAG", latency=10), result(mode="DIRECT", ok=False, latency=30), result("ZERO_SHOT", "RAG", latency=20)]
    got = {r.strategy: r for r in ev.mode_comparison(frame(spark, rows)).collect()}
    assert set(got) == {"COT", "ZERO_SHOT", "ALL"}
    assert got["COT"].accuracy_delta == 100.0 and got["COT"].latency_delta_ms == 20
    assert got["ALL"].rag_total == 2 and got["ALL"].rag_avg_latency_ms == 15 and got["ZERO_SHOT"].direct_total == 0


def test_best_strategy(spark):
    tie = [result("COT"), result("FEW_SHOT"), result("ZERO_SHOT", ok=False)]
    assert ev.best_strategy(frame(spark, tie)).first().best_strategy == "FEW_SHOT"
    none = [result("COT", ok=False), result("COT", "DIRECT")]
    assert tuple(ev.best_strategy(frame(spark, none)).first()) == ("ZERO_SHOT", 0.0)
    assert tuple(ev.best_strategy(frame(spark, none).limit(0)).first()) == ("ZERO_SHOT", 0.0)


def test_status_rate_and_grade(spark):
    rows = [result(), result(ok=False), result(ok=False, error="x")]
    assert {r.status: r.n_runs for r in ev.run_status(frame(spark, rows)).collect()} == {"ok": 1, "fail": 1, "err": 1}
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    hits = spark.createDataFrame([("a", 2, 5), ("a", 1, 6), ("b", 1, 5)], "query_id string, hit_rank int, id long")
    kb = spark.createDataFrame([(5, "five"), (6, "six")], "id long, title string")
    per = ev.case_hits(cases, hits, kb)
    assert {r.case_id: (r.n_hits, r.top_title) for r in per.collect()} == {"a": (2, "six"), "b": (1, "five"), "c": (0, None)}
    assert round(ev.hit_rate(per).first().hit_rate, 4) == 66.6667
    grades = spark.createDataFrame([(80.0,), (79.9,), (50.0,), (49.9,)], "r double").select(ev.hit_rate_grade(F.col("r"))).collect()
    assert [g[0] for g in grades] == ["good", "low", "low", "bad"]


def test_grid_and_requests(spark):
    cases = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, category string")
    assert ev.case_grid(cases).count() == 18 and ev.case_grid(cases, ["COT"], ["RAG"]).count() == 3
    assert ev.experiment_strategies("") == ev.experiment_strategies("all") == ["ZERO_SHOT", "FEW_SHOT", "COT"]
    assert ev.experiment_strategies("cot") == ["COT"]
    with pytest.raises(ValueError):
        ev.experiment_strategies("nope")
    assert [r.id for r in ev.first_n_cases(cases, 2).collect()] == ["a", "b"]
    assert ev.first_n_cases(cases, 0).count() == 3 and ev.category_count(cases).first()[0] == 2


def test_case_files(spark, tmp_path):
    cases = [{"id": f"c{i}", "category": "磁盘", "log": "l1\nl2 " + "é" * 100, "expected_root_cause": "r", "expected_keywords": ["a", "B"]} for i in range(3)]
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(cases, ensure_ascii=False, indent=2))
    read = files.read_cases(spark, str(path))
    assert [r.asDict() for r in read.orderBy("id").collect()] == cases
    rows, total = ev.case_summaries(read)
    assert total.first().total == 3
    assert rows.first().log_snippet.endswith("...") and len(rows.first().log_snippet.encode()) <= 123


def test_result_files(spark, tmp_path):
    rows = [result(confidence=0.03125, error=""), result(confidence=0.9, error="boom", ok=False)]
    files.write_results_csv(frame(spark, rows), str(tmp_path / "csv"))
    text = "".join(sorted(p.read_text() for p in (tmp_path / "csv").glob("part-*.csv")))
    assert text.splitlines()[0].startswith("case_id,category,mode,strategy,predicted_cause,expected_cause,is_correct,confidence")
    assert '"p, ""q"""' in text and "true,0.0312,10,1,3" in text and "false,0.9000" in text
    back = files.read_results(spark, str(tmp_path / "csv")).collect()
    assert {r.predicted_cause for r in back} == {'p, "q"'} and {r.confidence for r in back} == {0.0312, 0.9}
    files.write_results_json(frame(spark, rows), str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted("error" in x for x in lines) == [False, True] and lines[0]["log_snippet"] == "snippet"
