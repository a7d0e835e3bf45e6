"""Quality rules against plain counting and sorted quartiles."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultlens.llm import rules
from faultlens.llm.tables import table

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if twice[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


def plain_verdicts(rows):
    """rows: (key, lang, source, text) → key: (counts, base failed, broken rules), by sorting whole groups."""
    counts = {k: dict(zip(rules._COUNTS, plain_counts(t))) for k, _, _, t in rows}
    base = {k: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for k, c in counts.items()}

    def value(k, name):
        a, b, factor, *_ = rules.STATISTICS[name]
        return factor * counts[k][a] // counts[k][b]

    def edge(v):
        return v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6)

    out = {}
    for k, lang, source, _ in rows:
        broken = []
        if not base[k]:
            ok = [r for r in rows if not base[r[0]]]
            for group in ([r for r in ok if r[1:3] == (lang, source)], [r for r in ok if r[1] == lang], ok):
                if len(group) >= rules.MIN_GROUP:
                    break
            for name, (*_, least, both) in rules.STATISTICS.items():
                values = sorted(edge(value(r[0], name)) for r in group)
                low, high = values[(len(values) + 3) // 4 - 1], values[(3 * len(values) + 3) // 4 - 1]
                reach = 3 * max(high - low, least)
                if value(k, name) > high + reach or both and value(k, name) < low - reach:
                    broken.append(name)
        out[k] = (*list(counts[k].values())[:5], base[k], ",".join(broken) if not base[k] else "base")
    return out


def test_counts_of_texts():
    rng = random.Random(5)
    texts = ["", " ", "a", "a b", "a b c", "a b c a b c", "x x x x", "l1\nl1\n\n \nl1 \nl2", "#a *b $c | <d> é ß z", "\x0b\x0c\r a\x1cb"]
    texts += [" ".join(rng.choice("ab\n") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = rules.count_texts([t.encode() for t in texts])
    assert [tuple(int(got[c][i]) for c in rules._COUNTS) for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_windows_of_many_words_stay_exact():
    ids = rules.np.array([3, 1, 2, 3, 1, 2, 2**30, 5, 2**30, 5], dtype="int64")
    code = rules._windows(ids, 2**31, 3)
    assert code[0] == code[3] and len(set(code.tolist())) == len(code) - 1


def test_verdicts_equal_sorted_quartiles(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.lang, r.source, r.text) for r in docs.collect()]
    monkeypatch.setattr(rules, "MIN_GROUP", 12)  # all three levels occur
    want = plain_verdicts(rows)
    got = {r.doc_id: tuple(r)[1:7] + (r.failed_rules,) for r in rules.judge(docs).collect()}
    assert got == want_rows(want)
    assert {x for v in want.values() for x in v[6].split(",")} >= {"", "base", "symbols"}
    kept = {r.doc_id for r in rules.keep_passing(docs).collect()}
    assert kept == {k for k, v in want.items() if v[6] == ""}
    monkeypatch.setattr(rules, "MAX_BROADCAST_GROUPS", 0)  # the shuffled join gives the same
    assert {r.doc_id: tuple(r)[1:7] + (r.failed_rules,) for r in rules.judge(docs).collect()} == want_rows(want)


def want_rows(want):
    return {k: (*v[:5], v[5], v[6]) for k, v in want.items()}


def test_low_quality_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    rows = rules.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    shares = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] >= 0.995 and shares[0] <= 0.05


def test_sketches_merge_and_err_little(spark):
    rng = random.Random(9)
    values = [int(rng.lognormvariate(4, 3)) for _ in range(4000)] + [2**40, 0]
    edges = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(rules.bucket(F.col("v")).alias("b")).collect()]
    assert all(e <= v and (v - e) * 32 <= v for e, v in zip(edges, values)) and len(set(edges)) < 500
    rows = spark.createDataFrame([("a", "s", e % 3, e) for e in edges], "lang_key string, statistic string, part int, bucket long")
    parts = rows.groupBy("lang_key", "statistic", "part", "bucket").agg(F.count("*").alias("n"))
    got = rules.quartiles(rules.merge(parts, ["lang_key"]), ["lang_key"]).first()
    edges.sort()
    assert (got.total, got.low, got.high) == (4002, edges[(4002 + 3) // 4 - 1], edges[(3 * 4002 + 3) // 4 - 1])


@pytest.mark.parametrize("limit", [rules.MAX_BROADCAST_GROUPS, 0])
def test_odd_rows(spark, odd_docs, no_docs, monkeypatch, limit):
    monkeypatch.setattr(rules, "MAX_BROADCAST_GROUPS", limit)
    rows = rules.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.kept == (r.failed_rules == "") for r in rows)
    assert {(r.n_words, r.word_chars, r.base_failed) for r in rows if r.doc_id in (4, 5, 6)} == {(0, 0, True)}
    assert sum(r.kept for r in rows if r.doc_id == 3) in (0, 2)
    kept = rules.keep_passing(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rows)
    assert rules.judge(no_docs).count() == 0 and rules.keep_passing(no_docs).count() == 0
