"""Registered queries against their SQL twins, and the pipeline against its parts."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from faultlens.llm import minhash, quality
from faultlens.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLE[name], SF) == ""


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and len(QUERIES) == 13


def _groups(texts, shingle, percent):
    """Smallest key that links over all pairs reach, by comparing every pair of shingle sets."""
    sets = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        runs = [tuple(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([tuple(words)] if words else [])
        sets[key] = set(runs)
    root = {key: key for key in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(texts), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= percent * len(sets[x] | sets[y]):
            low, high = sorted((top(x), top(y)))
            root[high] = low
    return {key: top(key) for key in texts}


def _leaks(text, items, least=13):
    """Whether any window of ``least`` words (or a whole shorter item) agrees in four of five places with an item, at any shift."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    for item in items:
        n = min(least, len(item))
        agree = Counter(i - j for j, w in enumerate(item) for i in places.get(w, ()))
        for shift in [k for k, times in agree.items() if 5 * times >= 4 * n]:  # fewer agree in no window
            first, last = max(0, -shift), min(len(item), len(words) - shift)
            same = np.cumsum([0] + [words[i + shift] == item[i] for i in range(first, last)])
            for size in range(n, len(same)):
                if (5 * (same[size:] - same[:-size]) >= 4 * size).any():
                    return True
    return False


def test_pipeline_equals_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    accepted = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}  # tested apart
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in accepted}
    first = {key for key, group in _groups(texts, 5, 80).items() if key == group}
    asked = [[w for w in re.split(r"[\W_]+", r.text.lower()) if w] for r in items.collect()]
    want = {key for key in first if not _leaks(texts[key], asked)}
    result = corpus_pipeline.run(spark, SF)
    rows = result.collect()
    assert {r.doc_id for r in rows} == want and len(want) < len(first) < len(texts)
    assert result.columns == [*docs.columns, "slot", "shard"] and len({(r.doc_id, r.shard) for r in rows}) == len(want)


def test_pipeline_compares_each_text_under_a_repeated_id(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(80))
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, two), (2, three), (3, two + " end"), (4, one), (4, one), (1, one)]
    left = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, one), (1, two), (2, three)])
