"""Importance resampling against plain counting, and its exact cutoff on ties, repeated rows and crowded keys."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.llm import resample
from faultlens.llm.tables import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def expected(docs, items):
    """docs: (doc_id, text) rows with different ids."""
    counts = []
    for texts in ([t for _, t in docs], items):
        n = [0] * resample.BUCKETS
        for text in texts:
            for f in runs(text)[0]:
                n[zlib.crc32(f.encode()) % resample.BUCKETS] += 1
        counts.append(n)
    s, t = map(sum, counts)
    gains = [
        math.floor(1000 * math.log((b + 1) * (s + resample.BUCKETS) / ((a + 1) * (t + resample.BUCKETS)))) for a, b in zip(*counts)
    ]
    out = {}
    for i, text in docs:
        found, n_words = runs(text)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[zlib.crc32(f.encode()) % resample.BUCKETS] for f in found)
        out[i] = [i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words]
    able = sorted((r for r in out.values() if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for place, row in enumerate(able[:5 * len(able) // 100], 1):
        row[4] = place
    return out


@pytest.mark.parametrize("few", [1, resample.FEW_KEYS])
def test_resampling_equals_plain_counting(spark, few):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    got = {r.doc_id: list(r) for r in resample.resample(docs, items, few=few).collect()}
    assert got == want and sum(r[4] is not None for r in want.values()) > 5


def test_checksums_of_runs_with_any_bytes_and_very_long_words():
    rng = random.Random(3)
    texts = ["", "one", "a b", "ÄÖÜ straße 中文 x1", "Q" * 70 + " " + "z" * 5000 + " b", "\x00\x7f", "A-B_C"]
    texts += [" ".join("".join(rng.choice("abcXYZ09ß") for _ in range(rng.randint(1, 90))) for _ in range(40)) for _ in range(20)]
    bucket, owner, n_words = resample.features([t.encode() for t in texts], 2**32)
    for i, text in enumerate(texts):
        found, n = runs(text)
        assert sorted(bucket[owner == i]) == sorted(zlib.crc32(f.encode()) for f in found) and n_words[i] == n


@pytest.mark.parametrize("n_rows, n_scores", [(1, 1), (2, 2), (500, 500), (500, 3), (500, 1)])
def test_cutoff_is_exact_with_ties(spark, n_rows, n_scores):
    rng = random.Random(n_rows + n_scores)
    rows = [(-rng.randrange(n_scores), rng.randrange(40), rng.randrange(3), i) for i in range(n_rows)]
    keys = spark.createDataFrame(rows, "k_score long, k_id long, k_n long, k_row long").repartition(7)
    for n in {1, 2, n_rows // 3, n_rows}:
        if 1 <= n <= n_rows:
            assert resample.cutoff(keys, n, few=1) == sorted(rows)[n - 1]
    assert resample.cutoff(keys, 0) is None
    with pytest.raises(ValueError):
        resample.cutoff(keys, n_rows + 1)


def test_rounds_discard_a_quarter(spark, monkeypatch):
    """The weighted median of medians leaves three quarters at most in every round."""
    rows = [(i * 7919 % 10007, 0, 0, i) for i in range(4000)]
    keys = spark.createDataFrame(rows, "k_score long, k_id long, k_n long, k_row long").repartition(5)
    seen, plain = [], resample._medians

    def watched(batches):
        yield from plain(batches)

    monkeypatch.setattr(resample, "_medians", watched)
    monkeypatch.setattr(resample, "stage", lambda df, name: seen.append(df.count()) or df)
    assert resample.cutoff(keys, 1234, few=1) == sorted(rows)[1233]
    assert seen and all(b * 4 <= a for a, b in zip([4000, *seen], seen))


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "word1 word2 word3"), (2, None), (3, "")], "item_id long, text string")
    rows = resample.resample(odd_docs, items, percent=50, few=1).collect()
    assert len(rows) == odd_docs.count()
    able = [r for r in rows if r.n_words >= 20]
    drawn = sorted((r.rank for r in rows if r.rank is not None))
    assert drawn == list(range(1, len(able) // 2 + 1))
    best = sorted(able, key=lambda r: (-r.score, 2**63 if r.doc_id is None else r.doc_id, r.n_features))
    assert [tuple(r)[:4] for r in best[:len(drawn)]] == [tuple(r)[:4] for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)]
    assert {(r.n_features, r.weight) for r in rows if r.doc_id in (4, 5, 6)} == {(0, 0)}
    taken = resample.draw(odd_docs, items, percent=50)
    assert taken.columns == odd_docs.columns and {r.doc_id for r in taken.collect()} == {r.doc_id for r in rows if r.rank}
    assert resample.resample(no_docs, items).count() == 0 and resample.draw(no_docs, items).count() == 0
    assert resample.resample(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_repeated_rows_are_ranked_each(spark):
    """One row repeated makes up most of the table: each copy has a rank of its own, ranges part the copies."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(900).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(
        spark.range(100).select((F.col("id") + 10).alias("doc_id"), F.lit(text + " more").alias("text"))
    )
    items = spark.createDataFrame([(text,)], "text string")
    rows = [r for r in resample.resample(docs, items, percent=80, few=1).collect() if r.rank is not None]
    assert sorted(r.rank for r in rows) == list(range(1, 801))
    by_rank = [r.score for r in sorted(rows, key=lambda r: r.rank)]
    assert by_rank == sorted(by_rank, reverse=True)


def test_gains():
    assert np.array_equal(resample.bucket_gains([0, 0], [0, 0]), [0, 0])
    assert list(resample.bucket_gains([1, 3], [3, 1])) == [math.floor(1000 * math.log(2)), math.floor(1000 * math.log(0.5))]
