"""Text and vector search against brute force; fusion rules."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faultlens.functions import fixed_values as fv
from faultlens.operators import embedding, fusion, textsearch as ts, vectorsearch as vs
from faultlens.functions.vectors import cosine_similarity
from faultlens.operators.embedding import embed_report, hashed_vectors, model_vectors
from faultlens.operators.hybrid import hybrid_search, retrieved_ids

KB = "id long, title string, content string, category string, keywords string, symptoms string"


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def test_fts_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    # w0 is in nearly every article, so it must never decide the join
    kb = [(i, "", "w0 " * rng.randint(0, 3) + " ".join(rng.choices(vocabulary, k=rng.randint(0, 9))), "", rng.choice(["w1,W2", None, ""]), "")
          for i in range(80)]
    queries = [(i, " ".join(rng.choices(vocabulary + ["unknown"], weights=[3] * 12 + [1], k=rng.randint(0, 4)))) for i in range(40)]
    queries += [(100, "w0"), (101, "W0 w0!"), (102, "")]
    got = {(r.query_id, r.id): r.score for r in ts.fts_match(
        spark.createDataFrame(queries, "query_id long, query_text string"), spark.createDataFrame(kb, KB)).collect()}
    want = {}
    for qid, text in queries:
        asked = set(words(text))
        for row in kb:
            have = words((row[2] or "") + " " + (row[4] or ""))
            if asked and asked <= set(have):
                want[(qid, row[0])] = sum(w in asked for w in have) / len(have)
    assert got == want and len({q for q, _ in want}) > 5
    top = ts.fts_topk(spark.createDataFrame(queries, "query_id long, query_text string"), spark.createDataFrame(kb, KB), 3)
    for qid in {q for q, _ in want}:
        best = sorted((-s, i) for (q, i), s in want.items() if q == qid)[:3]
        assert [r.id for r in top.filter(F.col("query_id") == qid).orderBy("rank").collect()] == [i for _, i in best]


def test_fts_plan_has_no_cross_join(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    plan = ts.fts_topk(q, spark.createDataFrame([(1, "", "a b", "", "", "")], KB))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop|Python", plan)


def test_fts_candidates_are_dealt_by_word_and_part_and_not_shuffled_again(spark):
    q = spark.createDataFrame([(i, f"common w{i % 3}") for i in range(30)], "query_id long, query_text string")
    kb = spark.createDataFrame([(None if i == 7 else i, "", f"common w{i % 3} common", "", "", "") for i in range(300)], KB)
    found = ts.fts_match(q, kb)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and not re.search(r"Join \[id#", plan)
    assert {(r.query_id, r.id, r.score) for r in found.collect()} == {(a, b, 1.0) for a in range(30) for b in range(300) if a % 3 == b % 3 and b != 7}


def test_like_search(spark):
    kb = spark.createDataFrame(
        [(i, "", "", "", "", "CPU,disk usage 100x%") for i in range(10, 0, -1)] + [(99, "", "", "", "", "cpu"), (98, "", "", "", "", None)], KB)
    q = spark.createDataFrame([(1, ["CPU", "disk usage 100%"]), (2, ["运维"]), (3, ["502"])], "query_id long, keywords array<string>")
    got = {(r.query_id, r.keyword, r.id) for r in ts.like_match(q, kb, 3).collect()}
    assert got == {(1, k, i) for k in ("CPU", "disk usage 100%") for i in (1, 2, 3)}
    assert [(r.query_id, r.id, r["rank"]) for r in ts.like_distinct(q, kb, 3).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    # one-byte keywords are left out
    assert ts.like_hits(kb, 3, ["C"]).count() == 0


def vectors(rng, n, d=8):
    return rng.standard_normal((n, d)).astype(np.float32)


def frame(spark, key, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<float>")


def test_vector_topk_is_exact_for_any_blocking(spark):
    rng = np.random.default_rng(2)
    a, q = vectors(rng, 60), vectors(rng, 25)
    a[10], a[20] = a[5], a[5] * 3  # equal similarity: ordered by id
    articles = [*enumerate(a), (100, None), (101, [0.0] * 8), (102, [1.0, 2.0]), (103, [])]
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sims = np.round(unit(q) @ unit(a).T, 6)
    want = {}
    for i in range(25):
        pool = sorted([(-s, j) for j, s in enumerate(sims[i])] + [(0.0, 101)])[:4]
        want[i] = [j for _, j in pool]
    for blocks in ({}, {"article_block": 7, "query_block": 4}, {"article_block": 1000, "query_block": 3}):
        hits = vs.vector_topk(frame(spark, "query_id", enumerate(q)), frame(spark, "id", articles), 4, dim=8, **blocks).collect()
        got = {}
        for r in sorted(hits, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want


def test_bounded_topk_equals_the_full_product(spark):
    rng = np.random.default_rng(12)
    centres = vectors(rng, 12, 16) * 3
    a = np.concatenate([centres + 0.3 * vectors(rng, 12, 16) for _ in range(40)] + [vectors(rng, 60, 16)])
    a[7], a[300] = a[5] * 2, a[5]  # equal similarity: ordered by id
    articles = [*enumerate(a), (900, None), (901, [0.0] * 16), (902, [1.0, 2.0]), (903, [])]
    queries = [*enumerate(np.concatenate([centres + 0.2 * vectors(rng, 12, 16), vectors(rng, 20, 16)])), (500, [0.0] * 16), (501, None)]
    q, kb = frame(spark, "query_id", queries), frame(spark, "id", articles)
    want = sorted(map(tuple, vs.vector_topk(q, kb, 5, dim=16).collect()))
    for options in ({}, {"n_cells": 3}, {"n_cells": 60, "cell_rows": 11}):
        assert sorted(map(tuple, vs.vector_topk_bounded(q, kb, 5, dim=16, **options).collect())) == want
    visited = vs.vector_visits(q.filter("query_id < 12"), kb, 5, dim=16, n_cells=16).first()
    assert visited.share < 0.5  # of all pairs, where there are groups
    few = kb.filter("id < 3")
    assert vs.vector_topk_bounded(q, few, 5, dim=16).count() == vs.vector_topk(q, few, 5, dim=16).count()
    assert vs.vector_topk_bounded(q, kb.limit(0), 5).count() == vs.vector_topk_bounded(q.limit(0), kb, 5, dim=16).count() == 0


def test_blocks_of_vectors_are_shuffled_and_not_visits(spark):
    rng = np.random.default_rng(21)
    q, kb = frame(spark, "query_id", enumerate(vectors(rng, 300, 16))), frame(spark, "id", enumerate(vectors(rng, 400, 16)))
    hits = vs.vector_topk_bounded(q, kb, 5, dim=16)
    assert "explode(cast(cell" not in hits._jdf.queryExecution().toString() and "CoGroup" not in hits._jdf.queryExecution().toString()
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    assert vs.vector_visits(q, kb, 5, dim=16).first().n_compared > 0.9 * 300 * 400  # nothing can be skipped
    written = {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before}
    assert written == {"bounded-queries", "settled", "first-hits"}  # no row per query and cell


def test_topk_of_copies_and_vectors_that_are_not_finite(spark):
    rng = np.random.default_rng(22)
    a = np.concatenate([np.tile(vectors(rng, 1), (5000, 1)), vectors(rng, 3000), np.full((1, 8), np.nan, np.float32)])
    q = np.concatenate([a[:2], vectors(rng, 30), -a[:1]])
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sims = np.round(unit(q) @ unit(a[:-1]).T, 6)
    want = sorted((i, j, s[j], rank) for i, s in enumerate(sims) for rank, j in enumerate(np.lexsort((np.arange(8000), -s))[:7].tolist(), 1))
    for k in ({}, {"article_block": 900}):
        got = vs.vector_topk(frame(spark, "query_id", enumerate(q)), frame(spark, "id", enumerate(a)), 7, **k).collect()
        assert sorted((r.query_id, r.id, r.similarity, r["rank"]) for r in got) == want
    block = vs._Block(pa.array(range(len(a))), unit(a), None, 7)
    assert len(block.ids) == 3007  # of equal vectors as many as can be hits


def test_slack_keeps_most_neighbours(spark):
    rng = np.random.default_rng(13)
    centres = vectors(rng, 60, 64)
    points = np.concatenate([centres + 0.2 * vectors(rng, 60, 64) for _ in range(12)])
    kb, q = frame(spark, "id", enumerate(points)), frame(spark, "query_id", enumerate(points[:200]))
    exact = {(r.query_id, r.id) for r in vs.vector_topk(q, kb, 5).collect()}
    found = {(r.query_id, r.id) for r in vs.vector_topk_bounded(q, kb, 5, slack=0.1).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert vs.vector_visits(q, kb, 5, slack=0.1).first().share <= vs.vector_visits(q, kb, 5).first().share < 0.5


def test_vector_rank_drops_non_positive(spark):
    a = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])]
    hits = vs.vector_topk(frame(spark, "query_id", [(7, [1.0, 0.0])]), frame(spark, "id", a), 5)
    assert [(r.id, r.vec_rank) for r in vs.vector_rank(hits).orderBy("vec_rank").collect()] == [(1, 1), (4, 2)]


def test_ann_recall_and_crowded_cells(spark):
    rng = np.random.default_rng(4)
    centers = vectors(rng, 150, 64)
    near = np.concatenate([centers + 0.05 * vectors(rng, 150, 64) for _ in range(5)])
    crowd = np.tile(centers[0], (300, 1)) + 0.001 * vectors(rng, 300, 64)  # a third of the rows in one cell
    articles = frame(spark, "id", enumerate(np.concatenate([near, crowd])))
    queries = frame(spark, "query_id", enumerate(centers))
    exact = {(r.query_id, r.id): r.similarity for r in vs.vector_topk(queries, articles, 5).collect()}
    found = {(r.query_id, r.id): r.similarity for r in vs.vector_topk_ann(queries, articles, 5, n_bits=5, cell_rows=40).collect()}
    shared = set(exact) & set(found)
    assert len(shared) / len(exact) >= 0.9
    assert all(exact[key] == found[key] for key in shared)


def test_ann_recall_does_not_fall_with_the_number_of_bits(spark):
    rng = np.random.default_rng(9)
    points = vectors(rng, 1200, 64)  # without planted neighbours
    articles, queries = frame(spark, "id", enumerate(points)), frame(spark, "query_id", enumerate(points[:100]))
    exact = {(r.query_id, r.id) for r in vs.vector_topk(queries, articles, 5).collect()}
    for bits in (3, 6, 8):
        found = {(r.query_id, r.id) for r in vs.vector_topk_ann(queries, articles, 5, n_bits=bits).collect()}
        assert len(exact & found) >= 0.9 * len(exact), bits


def test_ann_writes_no_row_per_query_and_cell(spark, monkeypatch):
    rng = np.random.default_rng(10)
    points, written, stage = vectors(rng, 600, 64), [], vs.stage
    monkeypatch.setattr(vs, "stage", lambda df, name: written.append(stage(df, name)) or written[-1])
    articles, queries = frame(spark, "id", enumerate(points)), frame(spark, "query_id", enumerate([*points[:59], np.zeros(64)]))
    found = {(r.query_id, r.rank): r.id for r in vs.vector_topk_ann(queries, articles, 5, n_bits=4, cell_rows=30).collect()}
    assert max(df.count() for df in written) <= 5 * 60
    # the hits are the best of the cells that a query visits: its own and the next by the summed squares of the margins crossed
    planes = vs.hyperplanes(4, 64)
    cell = lambda x: sum(1 << j for j, p in enumerate(planes) if p @ x > 0)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for q in range(59):
        far = sorted((sum(float(p @ unit[q]) ** 2 for j, p in enumerate(planes) if c >> j & 1), c) for c in range(16))
        cells = {cell(unit[q]) ^ c for _, c in far[:13]}
        best = sorted((-round(float(unit[q] @ x), 6), i) for i, x in enumerate(unit) if cell(x) in cells)[:5]
        assert [found[q, r] for r in range(1, 6)] == [i for _, i in best]
    assert {k for k in found if k[0] == 59} == {(59, r) for r in range(1, 6)}


def test_cosine_similarity(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [round(r[0], 6) for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.707107, 0.0, 0.0, 0.0]


HITS = "query_id long, id long, source string, rank int, n_fts int"
ROWS = [
    (1, 10, "fts", 1, 2), (1, 11, "fts", 2, 2), (1, 11, "like", 1, 2), (1, 12, "like", 2, 2),
    (1, 10, "vector", 2, 2), (1, 13, "vector", 1, 2), (2, 20, "vector", 1, 0),
]


def test_merge_keeps_the_first_source(spark):
    merged = fusion.rrf_score(fusion.merge_sources(spark.createDataFrame(ROWS, HITS)))
    got = {(r.query_id, r.id): (r.source, r.ft_score, r.vec_score, r.rrf_score) for r in merged.collect()}
    assert got == {
        (1, 10): ("fts", 2.0, None, 1 / 62), (1, 11): ("fts", 1.0, None, 1 / 61), (1, 12): ("like", 1.5, None, 1 / 61.5),
        (1, 13): ("vector", None, 1.0, 1 / 61), (2, 20): ("vector", None, 1.0, 1 / 61),
    }


def test_fused_sums_over_sources(spark):
    got = {(r.query_id, r.id): r.rrf_score for r in fusion.rrf_fused(spark.createDataFrame(ROWS, HITS)).collect()}
    assert got == {(1, 10): 1 / 61 + 1 / 62, (1, 11): 1 / 62 + 1 / 61, (1, 12): 1 / 62, (1, 13): 1 / 61, (2, 20): 1 / 61}


def test_fuse_order_threshold_and_k(spark):
    hits = spark.createDataFrame(ROWS, HITS)
    rows = fusion.fuse(hits, k=3).orderBy("query_id", "hit_rank").collect()
    assert [(r.query_id, r.id) for r in rows] == [(1, 10), (1, 11), (1, 13), (2, 20)]
    assert rows[0].similarity_score == 1.0 and rows[3].similarity_score == 1.0
    assert [r.id for r in fusion.fuse(hits, threshold=0.9).filter("query_id = 1").collect()] == [10, 11]
    assert fusion.fuse(hits.limit(0)).count() == 0


def test_fuse_shuffles_once(spark):
    plan = fusion.fuse(spark.createDataFrame(ROWS, HITS))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_hybrid_search_end_to_end(spark):
    kb = [(1, "t1", "connection refused by db", "c", "502", "502,CPU"), (2, "t2", "cpu load", "c", "high cpu", "CPU"),
          (3, "t3", "unrelated", "c", "", "")]
    kb = spark.createDataFrame(kb, KB)
    kb = kb.join(hashed_vectors(kb.select("id", F.concat_ws("\n", "title", "content").alias("t")), "id", "t"), "id")
    logs = spark.createDataFrame([("a", ["CPU"], "cpu load"), ("b", ["运维"], "zzz")], "query_id string, keywords array<string>, processed_text string")
    found = hybrid_search(logs, kb)
    assert [r.id for r in found.filter("query_id = 'a'").orderBy("hit_rank").collect()][0] == 2
    ids = {r.query_id: r.retrieved_doc_ids for r in retrieved_ids(hybrid_search(logs, kb, embed=None)).collect()}
    assert ids == {"a": "2,1"}


def test_each_distinct_word_is_hashed_once(monkeypatch):
    seen, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda data, **options: seen.append(data) or md5(data, **options))
    texts = [["a", "ünö", "a"], None, [], ["a"] * 500 + ["b"], ["b"]]
    got = embedding._unit_vectors(pa.array(texts, pa.list_(pa.string()))).to_pylist()
    assert sorted(seen) == sorted({b"a", b"b", "ünö".encode()})
    for vector, text in zip(got, texts):
        want = np.zeros(64)
        for word in text or []:
            x, y, z = (int(digit, 16) for digit in md5(word.encode()).hexdigest()[:3])
            want[x % 4 * 16 + y] += 1 if z < 8 else -1
        assert vector == (list((want / np.sqrt((want * want).sum())).astype(np.float32)) if want.any() else None)


def test_hashed_and_model_vectors(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, ""), (3, "...")], "id long, text string")
    got = {r.id: r.embedding for r in hashed_vectors(df, "id", "text").collect()}
    assert got[2] is None and got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-6

    def factory():
        seen = {}

        def client(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "" or (text == "..." and seen[text] < 3):
                raise RuntimeError("busy")
            return [1.0, 2.0]

        return client

    vectors_ = model_vectors(df, "id", "text", factory, waits=(0, 0, 0))
    assert {r.id: r.embedding for r in vectors_.collect()} == {1: [1.0, 2.0], 2: None, 3: [1.0, 2.0]}
    before = df.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert embed_report(before, vectors_).first().asDict() == {"success": 2, "failed": 1}


def test_block_whose_later_slices_hold_no_hit_gives_the_best_of_all():
    rng = np.random.default_rng(7)
    units = rng.standard_normal((900, 16))
    units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
    asked = units[rng.permutation(900)[:300]]
    block = vs._Block(pa.array(np.arange(900)), units, None, 5, 64)
    points = np.rint(asked @ units.T * 10**vs.DIGITS).astype(np.int64)
    best = np.lexsort((np.broadcast_to(np.arange(900), points.shape), -points), axis=1)[:, :5]
    rows, cols, _ = block.best(asked, np.full(300, -np.inf))
    found = block.place[cols][np.lexsort((block.place[cols], -points[rows, block.place[cols]], rows))].reshape(300, 5)
    assert (found == best).all()
    # a bar that nothing reaches
    assert [len(x) for x in block.best(asked, np.full(300, 2.0))] == [0, 0, 0]


def test_block_begins_with_what_is_nearest_to_the_queries_and_finds_the_same():
    rng = np.random.default_rng(8)
    units = rng.standard_normal((900, 16))
    units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
    asked, cell = units[:40] + units[0], np.repeat([0, 1], 450)
    plain, turned = (vs._Block(pa.array(np.arange(900)), units, cell, 5, 64, towards) for towards in (None, asked.sum(axis=0)))
    nearness = turned.units @ asked.sum(axis=0)
    assert all((np.diff(nearness[i:i + 450]) <= 0).all() for i in (0, 450)) and (turned.place[:450] < 450).all()
    hits = []
    for block in (plain, turned):
        rows, cols, points = block.best(asked, np.full(40, -np.inf))
        hits.append(sorted(zip(rows.tolist(), block.ids.take(pa.array(cols)).to_pylist(), points.tolist())))
    assert hits[0] == hits[1]
    assert vs._Block(pa.array([1, 2]), np.full((2, 16), np.nan), None, 5, 64, np.ones(3)).slices == []
