"""Streams replayed in several micro-batches give the batch results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from faultlens.operators.embedding import hashed_vectors
from faultlens.operators.history import first_per_day
from faultlens.operators.hybrid import hybrid_search
from faultlens.operators.postings import search_index
from faultlens.operators.preprocess import preprocess, with_keywords
from faultlens.plans.catalog import streams
from faultlens.streaming import logs as st

TEXTS = ["ERROR CPU at 10.0.0.1", "nothing", "Connection refused password=x", "ERROR CPU at 10.0.0.2", "502 bad gateway", "info"]


def test_preprocess_stream_equals_batch(spark, tmp_path):
    logs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "query_id long, content string")
    for i in range(3):
        logs.filter(F.col("query_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = st.arriving(spark, str(tmp_path / "in"), logs.schema, maxFilesPerTrigger="1")
    st.write_stream(st.stream_preprocess(arriving), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("key_errors").collect()))
    assert got == sorted(map(tuple, preprocess(logs).drop("key_errors").collect()))


def test_documents_stream_from_a_file_and_from_a_folder(spark, tmp_path):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet", index=False)
    found = [sorted(map(tuple, streams.stream_preprocess(spark, str(tmp_path / kind)).collect())) for kind in ("folder", "file")]
    assert found[0] == found[1] and [r[0] for r in found[0]] == list(range(len(TEXTS)))


DEDUP = "log_hash string, ts timestamp, log_id long"
START = dt.datetime(2024, 1, 1)


def replay(spark, folder, steps, **options):
    """Runs the repeat filter over each step in a start of its own: new rows, late rows, state rows after each."""
    out, late, state, source = (str(folder / n) for n in ("out", "late", "state", "in"))
    held = []
    for rows in steps:
        if rows:
            spark.createDataFrame(rows, DEDUP).coalesce(1).write.mode("append").parquet(source)
        query = st.stream_dedup(st.arriving(spark, source, spark.createDataFrame([], DEDUP).schema), out, state, late, **options)
        query.awaitTermination()
        if query.lastProgress and query.lastProgress["stateOperators"]:
            held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    columns = ["log_hash", "ts", "log_id"]
    return (sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()), key=str),
            sorted(map(tuple, spark.read.parquet(late).select(*columns, "kind").collect()), key=str), held)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_dedup_stream_replayed_by_day(spark, tmp_path):
    # per day: one log that comes every day, one that comes every third day, one that never comes again
    steps = []
    for day in range(9):
        rows = [("daily", at(24 * day + 5), day * 10), ("daily", at(24 * day + 6), day * 10 + 1), (f"once{day}", at(24 * day + 7), day * 10 + 4)]
        if day % 3 == 0:
            rows += [("rare", at(24 * day + 1), day * 10 + 2), ("rare", at(24 * day + 2), day * 10 + 3)]
        steps.append(rows)
    new, late, held = replay(spark, tmp_path, steps, lateness="2 hours", sweep="1 ms")
    batch = first_per_day(spark.createDataFrame([r for rows in steps for r in rows], DEDUP)).select("log_hash", "ts", "log_id")
    assert new == sorted(map(tuple, batch.collect()), key=str) and late == []
    assert sum(r[0] == "rare" for r in new) == 3  # back after more than a day: new again
    # what cannot be repeated any more has left the store: it does not grow with the days
    assert max(held[3:]) <= max(held[:3]) + 1 and held[-1] <= 4


def test_dedup_stream_random_arrival_equals_batch(spark, tmp_path):
    """In order from step to step, in any order within one; half of all logs share a hash."""
    rng = random.Random(4)
    rows = sorted((at(rng.uniform(0, 400)), i) for i in range(1500))
    rows = [(rng.choice(["hot", f"h{rng.randrange(60)}"]), t, i) for t, i in rows]
    steps = [rows[i:i + 300] for i in range(0, len(rows), 300)]
    for step in steps:
        rng.shuffle(step)
    new, late, _ = replay(spark, tmp_path, steps, hours=3, lateness="0 seconds", sweep="1 ms")
    batch = first_per_day(spark.createDataFrame(rows, DEDUP), 3).select("log_hash", "ts", "log_id")
    assert new == sorted(map(tuple, batch.collect()), key=str) and late == []


def test_dedup_stream_sends_late_logs_aside(spark, tmp_path):
    steps = [
        [("a", at(24 * d), d) for d in (0, 2, 14, 30)] + [("a", at(24 * 30 + 3), 99), ("x", None, 50), (None, at(720), 51)],
        [],
        # a week too late; late by less than the lateness and a repeat; the same and new; no time at all
        [("a", at(24 * 7), 7), ("a", at(24 * 30 + 1), 98), ("b", at(24 * 30 - 20), 70), ("x", None, 71), (None, at(721), 72)],
    ]
    new, late, _ = replay(spark, tmp_path, steps, lateness="24 hours")
    assert sorted(r[2] for r in new) == [0, 2, 14, 30, 51, 70]
    assert {(r[2], r[3]) for r in late} == {(7, "late"), (50, "undated"), (71, "undated")}
    # once more the last batch, as after a failure before its commit
    for commit in (tmp_path / "state" / "commits").glob("*1*"):
        commit.unlink()
    again = replay(spark, tmp_path, [[]], lateness="24 hours")
    assert again[0] == new and again[1] == late


def test_retrieve_stream_equals_batch_and_repeats_safely(spark, tmp_path):
    kb = spark.createDataFrame(
        [(1, "t1", "connection refused by db", "c", "502", "Connection refused"), (2, "t2", "cpu load", "c", "CPU", "CPU"), (3, "t3", "x", "c", "", "502")],
        "id long, title string, content string, category string, keywords string, symptoms string")
    kb = kb.join(hashed_vectors(kb.select("id", "content"), "id", "content"), "id")
    logs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "query_id long, content string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(2):
        logs.filter(F.col("query_id") % 2 == i).coalesce(1).write.mode("append").parquet(source)
    arriving = st.arriving(spark, source, logs.schema, maxFilesPerTrigger="1")
    st.stream_retrieve(arriving, kb, out, state).awaitTermination()
    columns = ["query_id", "hit_rank", "id", "similarity_score"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    want = sorted(map(tuple, hybrid_search(with_keywords(preprocess(logs)), kb).select(*columns).collect()))
    assert got == want
    st.stream_retrieve(arriving, kb, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == len(want)


def test_retrieve_stream_writes_history_once_and_sees_new_articles(spark, tmp_path):
    schema = "id long, title string, content string, category string, keywords string, symptoms string"
    tables = [[(1, "t1", "connection refused by db", "c", "502", "Connection refused")], [(2, "t2", "cpu load", "c", "CPU", "CPU")]]
    logs = spark.createDataFrame([(i, t, dt.datetime(2024, 1, 1 + i)) for i, t in enumerate(TEXTS[:4])], "query_id long, content string, ts timestamp")
    source, out, state, history, base = (str(tmp_path / n) for n in ("in", "out", "state", "history", "index"))
    index = search_index(spark, base, 4)

    def articles():
        kb = spark.read.parquet(str(tmp_path / "kb"))
        return kb.join(hashed_vectors(kb.select("id", "content"), "id", "content"), "id")

    def run():
        arriving = st.arriving(spark, source, logs.schema)
        st.stream_retrieve(arriving, articles, out, state, history=history, index=index).awaitTermination()
        hits = spark.read.parquet(out).select("batch_id", "query_id", "hit_rank", "id")
        return sorted(map(tuple, hits.collect())), sorted(map(str, spark.read.parquet(history).collect()))

    for step, rows in enumerate(tables):
        new = spark.createDataFrame(rows, schema)
        new.write.mode("append").parquet(str(tmp_path / "kb"))
        index.add(new, step)
        logs.filter(F.col("query_id") % 2 == step).coalesce(1).write.mode("append").parquet(source)
        hits, kept = run()
    assert {(h[1], h[3]) for h in hits if h[3] == 2} and all(h[0] == 1 for h in hits if h[3] == 2)
    rows = spark.read.parquet(history).collect()
    assert len(rows) == 4 and len({r.session_id for r in rows}) == 4 and {r.created_at.day for r in rows} == {1, 2, 3, 4}
    first = next(r for r in rows if r.query_id == 2)
    assert first.retrieved_doc_ids.split(",")[0] == "1" and first.diagnosis_result.root_cause is None
    for commit in (tmp_path / "state" / "commits").glob("*1*"):  # the last batch once more, as after a failure
        commit.unlink()
    assert run() == (hits, kept)
