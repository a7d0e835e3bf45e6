"""Odd rows and empty tables: every operator has a result, and it is the stated one."""

import pytest
from pyspark.sql import functions as F

from faultlens.llm import decontam, egojoin, langid, lm, minhash, mixing, quality, secrets, sharding, substring
from tests.llm.conftest import BASE

ITEMS = [(1, BASE), (2, None), (3, ""), (None, "two words"), (4, " ".join(f"w{i % 977}x{i % 31}" for i in range(100, 130)))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (11, 1, 0), (12, 0, 1), (7, None, None), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_passages(odd_docs, no_docs):
    found = {(r.doc_id, r.other_id) for r in substring.repeated_passages(odd_docs).collect()}
    assert {(2, 1), (3, 1), (8, 7)} <= found and all(a is not None and b is not None and b < a for a, b in found)
    assert substring.repeated_passages(no_docs).count() == 0


def test_mixing(odd_docs, no_docs):
    rows = mixing.mix_report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.copies >= 1 for r in rows)
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


def test_quality(odd_docs, no_docs, labels):
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_accepted(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    unlabelled = quality.classify(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_secrets(odd_docs, no_docs):
    rows = {r.doc_id: r for r in secrets.scan(odd_docs).collect()}
    assert rows[10].spans == "assign:4:21" and rows[4].spans == rows[5].spans == "" and rows[4].base_sha256 == rows[5].base_sha256
    assert secrets.scan(odd_docs).count() == odd_docs.count() and secrets.scan(no_docs).count() == 0


def test_sharding(odd_docs, no_docs):
    placed = sharding.assign_shards(odd_docs, ["a", "b", "c"], 101)
    assert placed.columns == [c for c in odd_docs.columns if c != "slot"] + ["slot", "shard"]
    rows = placed.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.shard < 3 for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.assign_shards(no_docs, ["a"], 101).count() == 0


def test_language(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    nothing = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identify(no_docs).count() == 0


def test_language_model(odd_docs, no_docs):
    rows = lm.score(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0 and r.base_score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert lm.score(no_docs).count() == 0
    untrained = lm.score(odd_docs.filter("doc_id = 10"), held=1, held_rest=0).first()
    assert untrained.train_tokens == 0 and untrained.score == untrained.base_score == 0


def test_near_duplicates(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, 3, 85).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].component_id for i in (1, 2, 3)] == [1, 1, 1] and by_id[8].component_id == 7
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 for i in (4, 5, 6))
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    left = minhash.drop_near_duplicates(odd_docs, 5, 80)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.filter("doc_id IS NOT NULL").collect()) == [-5, 1, 4, 5, 6, 7, 9, 10, 11, 12, 12]  # two texts under one id
    assert left.filter("doc_id IS NULL").count() == 2
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).count() == 0


def test_overlaps(odd_docs, no_docs, items):
    found = {(r.doc_id, r.item_id) for r in decontam.overlaps(odd_docs, items).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (None, 1), (7, 4), (8, 4)}
    left = decontam.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 7
    sliced = {(r.doc_id, r.item_id) for r in decontam.overlaps(odd_docs, items, seeds_at_once=40).collect()}
    assert sliced == found
    assert decontam.overlaps(no_docs, items).count() == 0 and decontam.overlaps(odd_docs, items.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [], 0),
        (8, [0.0, 0.0], 0), (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (11, [None, 1.0], 0), (12, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [2.0, 0.0], 0),
    ]
    rows += [(20, [0.0, 5.0], 3), (20, [0.0, 5.1], 3), (21, [5.0, 0.0], 3)]  # two vectors under one id are no links
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, unit string, block int")
    got = egojoin.similar_vectors(vectors).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by_id[1] == (2, 1, True) and by_id[2] == (2, 1, False) and by_id[3] == (2, 1, False)
    assert all(by_id[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and by_id[None] == (0, None, True)
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in got if r.vec_id in (20, 21))
    assert egojoin.similar_vectors(vectors.limit(0)).count() == 0
