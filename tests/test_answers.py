"""Answer parsing, prompts, model hooks and the whole diagnosis."""

import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
import json

from pyspark.sql import functions as F

from faultlens.functions import answers as an
from faultlens.functions.answers import DIAGNOSIS
from faultlens.functions import fixed_values as fv
from faultlens.functions.prompts import ARTICLES_TITLE, EXAMPLES, STEPS, pick_strategy
from faultlens.operators.history import history_rows
from faultlens.operators.inference import _Pace, answers_kept, model_answers, recorded_answers, stored_answers
from faultlens.operators.prompting import assemble_prompt, miss_to_cot
from faultlens.plans.diagnose import bad_answers, diagnose_and_store, diagnose_batch
from faultlens.plans.experiment import run_experiment
from faultlens.sources import schemas

GOOD = {"root_cause": "db down", "analysis_process": "x", "solution_steps": ["a", "b"], "confidence": 0.9}
TEXTS = {
    json.dumps(GOOD): ("whole", "db down", ["a", "b"], 0.9),
    "Sure:\n" + json.dumps(GOOD) + "\nbye": ("embedded", "db down", ["a", "b"], 0.9),
    json.dumps(GOOD) + json.dumps(GOOD): ("failed", fv.PARSE_FAILED, [], 0.0),
    json.dumps(GOOD) + "],[" + json.dumps(GOOD): ("failed", fv.PARSE_FAILED, [], 0.0),
    json.dumps(GOOD) + "," + json.dumps(GOOD): ("failed", fv.PARSE_FAILED, [], 0.0),
    json.dumps(GOOD) + " done": ("embedded", "db down", ["a", "b"], 0.9),
    json.dumps(GOOD) + "}": ("failed", fv.PARSE_FAILED, [], 0.0),
    '{"root_cause": "r", "root_cause": "s"}': ("whole", "s", [], 0.0),
    "{broken": ("failed", fv.PARSE_FAILED, [], 0.0),
    "": ("failed", fv.PARSE_FAILED, [], 0.0),
    "null": ("empty", "", [], 0.0),
    "[1]": ("failed", fv.PARSE_FAILED, [], 0.0),
    "[" + json.dumps(GOOD) + "]": ("embedded", "db down", ["a", "b"], 0.9),
    '{"root_cause": 5, "confidence": "0.9"}': ("whole", "", [], 0.0),
    '{"root_cause": null, "solution_steps": ["a", 1, null, true]}': ("whole", "", ["a", "", "", ""], 0.0),
    '{"root_cause": "r", "solution_steps": "none", "confidence": 1}': ("whole", "r", [], 1.0),
    '{"root_cause": "r", "confidence": 1e-2}': ("whole", "r", [], 0.01),
    '{"root_cause": ["r"], "confidence": true}': ("whole", "", [], 0.0),
    "{}": ("whole", "", [], 0.0),
}


def test_parse_and_fields(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, raw_content string")
    rows = an.answer_fields(an.parse_answers(df)).orderBy("i").collect()
    got = [(r.parse_kind, r.root_cause, r.solution_steps, r.confidence) for r in rows]
    assert got == list(TEXTS.values())
    assert rows[8].analysis_process == "{broken" and rows[0].analysis_process == "x"
    keys = an.parse_answers(df).orderBy("i").select(an.parsed_keys(F.col("parsed"))).collect()
    assert keys[0][0] == sorted(GOOD) and keys[10][0] == []


def test_diagnosis_json_round_trip(spark):
    df = spark.createDataFrame([(("c", 'a "q"', ["s,1"], 0.25),)], f"d {an.DIAGNOSIS}")
    back = df.select(an.diagnosis_from_json(an.diagnosis_to_json(F.col("d"))).alias("d")).first().d
    assert back == df.first().d


def test_strategy_and_miss(spark):
    df = spark.createDataFrame([("cot", True, 0), ("ZERO_shot", True, 2), ("x", False, 0), (None, True, None)],
                               "strategy string, use_rag boolean, n_hits int")
    rows = miss_to_cot(df.withColumn("strategy", pick_strategy(F.col("strategy")))).collect()
    assert [(r.strategy, r.rag_missed) for r in rows] == [("COT", True), ("ZERO_SHOT", False), ("FEW_SHOT", False), ("COT", True)]


ARTICLES = "array<struct<hit_rank:int,id:long,title:string,content:string>>"


def test_prompts(spark):
    rows = [(s, "LOG", a) for s in ["ZERO_SHOT", "FEW_SHOT", "COT", "other"] for a in ([(1, 7, "t", "c")], [], None)]
    out = assemble_prompt(spark.createDataFrame(rows, f"strategy string, processed_text string, articles {ARTICLES}")).collect()
    for r in out:
        assert "LOG" in r.user_prompt and r.full_prompt == r.user_prompt
        assert (ARTICLES_TITLE in r.user_prompt) == bool(r.articles) == ("- [案例7] t: c" in r.user_prompt)
        assert (EXAMPLES in r.user_prompt) == (r.strategy in ("FEW_SHOT", "other"))
        assert (STEPS in r.user_prompt) == (r.strategy == "COT")


def _client_factory():
    calls = {}

    def client(request):
        assert request["temperature"] == 0.1 and request["max_tokens"] == 2048
        user = request["messages"][1]["content"]
        calls[user] = calls.get(user, 0) + 1
        if user == "never" or (user == "third" and calls[user] < 3):
            raise RuntimeError("busy")
        return f"answer to {user}", 11

    return client


def test_model_hook_retries_and_reports_errors(spark):
    prompts = spark.createDataFrame([(i, "s", u) for i, u in enumerate(["a", "third", "never"])], "query_id int, system_prompt string, user_prompt string")
    rows = model_answers(prompts, ["query_id"], _client_factory, waits=(0, 0, 0)).orderBy("query_id").collect()
    assert [r.raw_content for r in rows] == ["answer to a", "answer to third", None]
    assert [r.error for r in rows] == [None, None, "no answer after 3 attempts"] and rows[0].total_tokens == 11


def _counting(folder, breaks=None):
    """A client that notes each request in the folder; at the prompt ``breaks`` the whole task dies."""

    def factory():
        def client(request):
            user = request["messages"][1]["content"]
            with open(f"{folder}/calls", "a") as f:
                f.write(user + "\n")
            if user == breaks:
                raise SystemExit("killed")
            if user == "never":
                raise RuntimeError("busy")
            return f"answer to {user}", 7

        return client

    return factory


def _calls(folder):
    return Counter((folder / "calls").read_text().split("\n")[:-1]) if (folder / "calls").exists() else Counter()


def test_kept_answers_are_asked_once(spark, tmp_path):
    rows = [(i, "s", f"u{i % 30}") for i in range(200)] + [(500, "s", "never"), (501, None, None)]
    prompts = spark.createDataFrame(rows, "query_id int, system_prompt string, user_prompt string").repartition(6)
    options = {"waits": (0, 0), "per_task": 4, "in_flight": 3}
    run = lambda **more: {
        r.query_id: (r.raw_content, r.error) for r in answers_kept(prompts, ["query_id"], _counting(tmp_path), str(tmp_path / "store"), **options, **more).collect()}
    first = run()
    assert first[0] == ("answer to u0", None) == first[30] and first[500] == (None, "no answer after 2 attempts") and len(first) == 202
    once = _calls(tmp_path)
    assert all(once[f"u{i}"] == 1 for i in range(30)) and once["never"] == 2
    assert run() == first
    assert _calls(tmp_path) - once == Counter({"never": 2})  # only what had no answer
    run(temperature=0.9)  # other settings are another question
    assert _calls(tmp_path)["u3"] == 2


def test_a_killed_run_keeps_the_answers_of_finished_tasks(spark, tmp_path):
    prompts = spark.createDataFrame([(i, "s", f"u{i}") for i in range(60)], "query_id int, system_prompt string, user_prompt string")
    options = {"waits": (0,), "per_task": 3, "in_flight": 1}
    with pytest.raises(Exception):
        answers_kept(prompts, ["query_id"], _counting(tmp_path, "u7"), str(tmp_path / "store"), **options).count()
    kept = {r.prompt_hash for r in stored_answers(spark, str(tmp_path / "store")).collect()}
    before = _calls(tmp_path)
    assert kept and before["u7"] >= 1
    done = answers_kept(prompts, ["query_id"], _counting(tmp_path), str(tmp_path / "store"), **options).collect()
    assert len(done) == 60 and all(r.error is None for r in done)
    again = _calls(tmp_path) - before
    assert len(again) == 60 - len(kept) and set(again.values()) == {1}


def test_pace_of_requests():
    pace, start = _Pace(200), time.monotonic()
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: pace.wait(), range(21)))
    assert time.monotonic() - start >= 0.1


def test_recorded_answers(spark):
    prompts = spark.createDataFrame([(1, "u1"), (2, "u2")], "query_id int, user_prompt string")
    record = prompts.filter("query_id = 1").select(F.sha2("user_prompt", 256).alias("prompt_hash"), F.lit("{}").alias("raw_content"),
                                                   F.lit(3).alias("total_tokens"), F.lit(4).alias("latency_ms"))
    rows = recorded_answers(prompts, record, ["query_id"]).orderBy("query_id").collect()
    assert [(r.raw_content, r.error) for r in rows] == [("{}", None), (None, "no recorded answer")]


def kb(spark):
    return spark.createDataFrame(
        [(1, "t1", "connection refused by db", "c", "502", "Connection refused"), (2, "t2", "cpu load", "c", "CPU", "CPU")],
        "id long, title string, content string, category string, keywords string, symptoms string")


def answerer(prompts):
    text = F.when(F.col("user_prompt").contains("ERROR bad"), '{"x": 1}').when(
        F.col("user_prompt").contains("ERROR none"), None).otherwise(json.dumps(GOOD))
    return prompts.select(
        *[c for c in ["query_id", "case_id", "strategy", "mode"] if c in prompts.columns and (c == "query_id" or "case_id" in prompts.columns)],
        text.alias("raw_content"), F.when(text.isNull(), "no answer").alias("error"), F.lit("m").alias("model_used"),
        F.lit(5).alias("total_tokens"), F.lit(6).cast("long").alias("latency_ms"))


def test_diagnose_batch(spark):
    logs = spark.createDataFrame(
        [(1, "ERROR CPU", "zero_shot", True), (2, "ERROR bad", "cot", True), (3, "ERROR none", "x", False), (4, "ERROR quiet", None, True),
         (5, "seen 10.0.0.1", "cot", True)], "query_id long, content string, strategy string, use_rag boolean")
    seen = logs.filter("query_id = 5").select(
        F.lit(77).cast("long").alias("id"), F.sha2(F.lit("seen [IP_REDACTED]"), 256).alias("log_hash"),
        F.struct(F.lit("old").alias("root_cause"), F.lit("").alias("analysis_process"), F.array(F.lit("s")).alias("solution_steps"),
                 F.lit(0.5).alias("confidence")).alias("diagnosis_result"))
    done = diagnose_batch(logs, kb(spark), seen, answerer, embed=None)
    rows = {r.query_id: r for r in done.collect()}
    assert {i: r.status for i, r in rows.items()} == {1: "ok", 2: "bad", 3: "error", 4: "ok", 5: "cache"}
    assert rows[1].strategy == "ZERO_SHOT" and rows[1].retrieved_doc_ids == "2" and not rows[1].rag_missed
    assert rows[4].strategy == "COT" and rows[4].rag_missed and rows[3].strategy == "FEW_SHOT"
    assert rows[5].history_id == 77 and rows[5].root_cause == "old"
    assert [r.parsed_keys for r in bad_answers(done).collect()] == [["x"]]
    assert history_rows(done.filter("status = 'ok'")).count() == 2


def test_diagnose_and_store_twice(spark, tmp_path):
    logs = spark.createDataFrame(
        [(1, "ERROR CPU", "zero_shot", True), (2, "ERROR bad", "cot", True), (4, "ERROR quiet", None, True), (5, "ERROR quiet", "cot", True)],
        "query_id long, content string, strategy string, use_rag boolean")
    stamp = F.lit("2024-01-01").cast("timestamp")
    articles = kb(spark).select("*", F.lit(None).cast("array<float>").alias("embedding"), stamp.alias("created_at"), stamp.alias("updated_at"))
    history = spark.createDataFrame([], "id long, log_hash string, diagnosis_result " + DIAGNOSIS)
    for _ in range(2):  # the repeat replaces what the first run wrote
        made = diagnose_and_store(logs, articles, history, answerer, str(tmp_path), "a", stamp)
        rows = made["history"].orderBy("id").collect()
        assert [r.id for r in rows] == [1, 2, 3] and len({r.session_id for r in rows}) == 3
        learned = made["articles"].filter("id > 2").collect()
        assert made["articles"].count() == 3 and len(learned) == 1 and learned[0].embedding is not None
    later = diagnose_and_store(logs, made["articles"], made["history"], answerer, str(tmp_path), "b", stamp)
    assert {r.query_id: r.status for r in later["outcome"].collect()} == {1: "cache", 2: "bad", 4: "cache", 5: "cache"}
    assert later["history"].count() == 0 and later["articles"].count() == 3


def test_run_experiment(spark):
    cases = spark.createDataFrame(
        [("a", "CPU", "ERROR CPU", "the db is down", ["db", "down"]), ("b", "x", "ERROR none", "zzzz", ["q", "r", "s", "t"]),
         ("c", "x", "ERROR quiet", "unrelated words", ["q", "r"])], schemas.CASES)
    rows = run_experiment(cases, kb(spark), answerer, embed=None).collect()
    assert len(rows) == 18
    by = {(r.case_id, r.strategy, r["mode"]): r for r in rows}
    assert by[("a", "COT", "RAG")].knowledge_used == 1 and by[("a", "COT", "DIRECT")].knowledge_used == 0
    assert by[("a", "COT", "RAG")].is_correct and not by[("c", "COT", "RAG")].is_correct
    assert by[("b", "COT", "RAG")].error == "no answer" and by[("b", "COT", "RAG")].confidence == 0.0
