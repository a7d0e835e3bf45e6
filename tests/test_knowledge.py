"""Knowledge table changes, paging, history and feedback."""

import datetime as dt

from pyspark.sql import functions as F

from faultlens.functions import articles as art
from faultlens.functions import fixed_values as fv
from faultlens.operators import history as hist, knowledge as kn
from faultlens.sources import schemas

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def table(spark, rows):
    full = [(i, t, c, "cat", "k", s, e, T0, T0) for i, t, c, s, e in rows]
    return spark.createDataFrame(full, schemas.KNOWLEDGE)


def base(spark):
    return table(spark, [(1, "a", "ca", "", [1.0]), (2, "b", "cb", "", None), (3, "c", "cc", "", [3.0])])


def failing(df, key, text):
    return df.select(key, F.lit(None).cast("array<float>").alias("embedding"))


def test_insert_numbers_rows_and_rejects_empty(spark):
    rows = spark.createDataFrame(
        [("x", "cx", "", "", ""), ("", "c", "", "", ""), ("t", None, "", "", "")] + [("same", "text", None, "", "")] * 25_000,
        "title string, content string, category string, keywords string, symptoms string")
    after = kn.kb_insert(base(spark), rows, now=now())
    ids = sorted(r.id for r in after.select("id").collect())
    assert ids == list(range(1, 3 + 25_001 + 1))
    again = kn.kb_insert(base(spark), rows, now=now())
    pick = lambda df: df.filter("title = 'x'").first().id
    assert pick(after) == pick(again)
    assert kn.kb_rejected_rows(rows).count() == 2


def test_update_keeps_old_vector_when_embedding_fails(spark):
    changes = spark.createDataFrame([(1, "n", "m", "c", "", ""), (9, "n", "m", "c", "", "")],
                                    "id long, title string, content string, category string, keywords string, symptoms string")
    after = {r.id: r for r in kn.kb_update(base(spark), changes, embed=failing, now=now()).collect()}
    assert len(after) == 3 and after[1].title == "n" and after[1].embedding == [1.0] and after[1].symptoms == ""
    assert str(after[1].updated_at) == "2024-02-01 00:00:00" and after[2].updated_at == T0
    assert [r.id for r in kn.kb_update_rejects(base(spark), changes).collect()] == [9]
    fresh = {r.id: r for r in kn.kb_update(base(spark), changes, now=now()).collect()}
    assert len(fresh[1].embedding) == 64


def test_delete_and_backfill(spark):
    ids = spark.createDataFrame([(2,), (77,)], "id long")
    assert sorted(r.id for r in kn.kb_delete(base(spark), ids).collect()) == [1, 3]
    filled = {r.id: r.embedding for r in kn.kb_backfill(base(spark)).collect()}
    assert filled[1] == [1.0] and len(filled[2]) == 64


def test_seed_twice_adds_nothing(spark):
    cases = spark.createDataFrame(
        [("c1", "磁盘", "log1", "disk broke", ["raid", "disk"]), ("c2", "OOM", "log2", "oom", ["memory"])], schemas.CASES)
    once = kn.kb_seed(base(spark), cases, now=now())
    twice = kn.kb_seed(once, cases, now=now())
    assert once.count() == 5 and twice.count() == 5
    row = once.filter("category = '磁盘'").first()
    assert row.title == "[磁盘] disk broke" and row.keywords == row.symptoms == "raid,disk"
    # memory and raid rules differ in order between trigger and solution
    assert fv.TRIGGER_RULES[1][1] in row.content and fv.SOLUTION_RULES[0][1] in row.content


def test_seeding_is_the_same_without_joins_on_the_texts(spark):
    kb = table(spark, [
        (1, "a", "ca b", "", [1.0]), (2, "b", "cb d", "", None), (3, "", "", "", None), (4, "x", "y z", "", None), (4, "x", "y w", "", None),
        (4, "x", "w", "", [2.0]), (None, "n", "n m", "", None), (5, "t", "text", "", [1.0]), (5, "t", "text", "", [1.0]),
    ])
    log = [(f"c{i}", "内存", f"text {i // 2}", f"cause {i % 3}", ["OOM", "CPU"]) for i in range(40)] + [("c99", None, "text", "", None)]
    cases = spark.createDataFrame(log, "id string, category string, log string, expected_root_cause string, expected_keywords array<string>")
    by_key = lambda df, key, text: kn.hashed_vectors(df, key, text)  # noqa: E731  a service that is asked by key
    rows = lambda df: sorted(df.collect(), key=repr)
    assert rows(kn.kb_backfill(kb)) == rows(kn.kb_backfill(kb, by_key))
    once, plain = kn.kb_seed(kb, cases, now=now()), kn.kb_seed(kb, cases, by_key, now=now())
    assert once.columns == plain.columns and rows(once) == rows(plain) and once.filter("title LIKE '[%'").count() > 20
    # nothing new: no text is shuffled, nor is any where the ids differ
    own = kb.filter("id < 4")
    for done in (kn.kb_backfill(own), kn.kb_seed(kn.kb_seed(own, cases, now=now()), cases, now=now())):
        plan = done._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftOuter" not in plan


def test_rule_orders(spark):
    df = spark.createDataFrame([(["RAID", "memory"],), (["none"],)], "k array<string>")
    got = df.select(art.infer_trigger(F.col("k")).alias("t"), art.infer_solution(F.col("k")).alias("s")).collect()
    assert got[0].t == fv.TRIGGER_RULES[0][1] and got[0].s == fv.SOLUTION_RULES[0][1]
    assert got[1].t == fv.TRIGGER_DEFAULT and got[1].s == fv.SOLUTION_DEFAULT


def test_category_uses_written_order(spark):
    df = spark.createDataFrame([(["Connection refused", "Java heap space"],), (["Deadlock"],), ([],)], "k array<string>")
    assert [r[0] for r in df.select(art.infer_category(F.col("k"))).collect()] == ["内存", "数据库", "自动学习"]


def test_auto_learn(spark):
    rows = [
        (True, "whole", "h1", ["CPU"], "cause " * 30, "why", ["s1", "s2"]),
        (True, "whole", "h1", ["CPU"], "other", "why", []),
        (True, "failed", "h2", [], fv.PARSE_FAILED, "raw", []),
        (False, "whole", "h3", [], "hit", "why", []),
        (True, "whole", "h4", [], "", "why", []),
    ]
    diagnoses = spark.createDataFrame(
        rows, "rag_missed boolean, parse_kind string, original_hash string, key_errors array<string>, "
              "root_cause string, analysis_process string, solution_steps array<string>")
    after = kn.auto_learn(base(spark), diagnoses, now=now())
    assert after.count() == 4
    row = after.filter("id = 4").first()
    assert row.title == ("cause " * 30)[:80] + "..." and row.keywords == "CPU"
    assert row.content.endswith("【修复步骤】\n1. s1\n2. s2\n")
    # the same misses again teach nothing, nor do logs that were learned from before
    again = kn.auto_learn(after, diagnoses, now=now())
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in after.collect())
    learned = spark.createDataFrame([("h1",)], "log_hash string")
    assert kn.auto_learn(base(spark), diagnoses, now=now(), learned=learned).count() == 3


def test_search_and_pages(spark):
    kb = table(spark, [(i, f"t{i}", "50% off" if i % 2 else "half_off", "", None) for i in range(1, 131)])
    assert kn.kb_search(kb, "50% o").count() == 65 and kn.kb_search(kb, "f_o").count() == 65
    assert kn.kb_search(kb, "0%f").count() == 65 and kn.kb_search(kb, "0%f", escape=True).count() == 0
    assert kn.kb_search(kb, "T1").count() == 0 and kn.kb_search(kb, "").count() == 130
    assert kn.clamp_page(0, 0) == (1, 20) and kn.clamp_page(-3, 101) == (1, 20) and kn.clamp_page(2, 100) == (2, 100)
    rows, total = kn.kb_page(kb, "", page=2, size=100)
    assert [r.id for r in rows.collect()] == list(range(30, 0, -1)) and total.first().total == 130
    assert kn.kb_page(kb, "", page=9, size=100)[0].count() == 0


def test_keyset_pages_equal_offset_pages(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(hours=i * 7 % 11), "x") for i in range(137)]  # many rows of one time
    df = spark.createDataFrame(rows, "id long, created_at timestamp, v string")
    kn.write_pages(df.repartition(5), ["created_at", "id"], str(tmp_path / "pages"), rows_per_file=10)
    kept, after, got = spark.read.parquet(str(tmp_path / "pages")), None, []
    while True:
        page = kn.page_after(kept, ["created_at", "id"], after, 20).collect()
        if not page:
            break
        got.append([r.id for r in page])
        after = (page[-1].created_at, page[-1].id)
    order = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    assert [i for page in got for i in page] == [r[0] for r in order] and [len(p) for p in got] == [20] * 6 + [17]
    later = kn.page_after(kept, ["created_at", "id"], (T0 + dt.timedelta(hours=2), 50), 20)
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at" in plan and "TakeOrderedAndProject" in plan
    assert kn.page_after(kept, ["created_at", "id"], (T0 - dt.timedelta(days=1), 0)).count() == 0


def test_feedback(spark):
    rows = spark.createDataFrame([("s", 1, "ok"), ("s", 0, None), ("s", 2, ""), ("", 1, ""), (None, 1, "")],
                                 "session_id string, feedback int, user_comment string")
    good = hist.valid_feedback(rows)
    assert sorted((r.feedback, r.user_comment) for r in good.collect()) == [(0, ""), (1, "ok")]
    assert hist.feedback_stats(good).first().asDict() == {"feedback_correct": 1, "feedback_incorrect": 1}
    assert hist.feedback_stats(good.limit(0)).first().asDict() == {"feedback_correct": 0, "feedback_incorrect": 0}


def test_hash_lookup(spark):
    logs = spark.createDataFrame([("a", 1), ("b", 2)], "original_hash string, log_id long")
    history = spark.createDataFrame([(5, "a", "second"), (4, "a", "first")], "id long, log_hash string, diagnosis_result string")
    got = {r.log_id: (r.history_id, r.cached_result) for r in hist.hash_lookup(logs, history).collect()}
    assert got == {1: (4, "first"), 2: (None, None)}
    assert [r.log_id for r in hist.new_logs(logs, history).collect()] == [2]


def test_lookup_within_a_day(spark):
    import random

    rng = random.Random(3)
    name = lambda: "hot" if rng.random() < 0.4 else f"h{rng.randrange(15)}"
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(60 * 90))
    logs = [(i, name(), at()) for i in range(400)] + [(900, "edge", T0 + dt.timedelta(hours=24)), (901, "edge", T0 + dt.timedelta(hours=24, seconds=1)),
            (902, None, T0), (903, "edge", None), (904, "edge", T0), (905, "edge", T0 - dt.timedelta(seconds=1))]
    known = [(i, name(), at(), f"d{i}") for i in range(120)] + [(500, "edge", T0, "d500"), (501, "edge", None, "x"), (502, None, T0, "x")]
    history = spark.createDataFrame(known, "id long, log_hash string, created_at timestamp, diagnosis_result string")
    for hours in (24, 5, 1):
        got = {r.log_id: (r.history_id, r.cached_result) for r in hist.lookup_within(
            spark.createDataFrame(logs, "log_id long, original_hash string, ts timestamp"), history, hours).collect()}
        want = {}
        for i, h, t in logs:
            near = [(at, k, d) for k, g, at, d in known if None not in (h, t, at) and g == h and dt.timedelta() <= t - at <= dt.timedelta(hours=hours)]
            want[i] = max(near)[1:] if near else (None, None)
        assert got == want
    assert got[900] == (None, None)


def test_first_per_day_matches_brute_force(spark):
    import random

    rng = random.Random(9)
    # one hash holds a third of the rows
    rows = [(("hot" if rng.random() < 0.34 else f"h{rng.randint(0, 40)}"), T0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 20)), i)
            for i in range(1500)]
    rows += [("edge", T0, 9001), ("edge", T0 + dt.timedelta(hours=24), 9002), ("edge", T0 + dt.timedelta(hours=48, seconds=1), 9003)]
    last, want = {}, set()
    for h, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if h not in last or ts - last[h] > dt.timedelta(hours=24):
            want.add(i)
        last[h] = ts
    got = hist.first_per_day(spark.createDataFrame(rows, "log_hash string, ts timestamp, log_id long"))
    assert {r.log_id for r in got.collect()} == want


def test_history_rows(spark):
    d = spark.createDataFrame([("h", "p" * 600, None, "c", "a", ["s"], 0.5, "m", "COT", 3, 4)],
                              "original_hash string, processed_text string, retrieved_doc_ids string, root_cause string, "
                              "analysis_process string, solution_steps array<string>, confidence double, model_used string, "
                              "strategy string, total_tokens int, latency_ms int")
    row = hist.history_rows(d).first()
    assert len(row.session_id) == 36 and len(row.log_snippet) == 503 and row.retrieved_doc_ids == ""
    assert row.diagnosis_result.solution_steps == ["s"] and row.prompt_strategy == "COT"
