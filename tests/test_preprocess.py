"""Masking, line choice, tags and text helpers on edge rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions import text as tx
from faultlens.functions.lines import line_weight
from faultlens.functions.masking import mask
from faultlens.functions.tagging import key_errors, retrieval_keywords
from faultlens.operators import preprocess as pp


def apply(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("t"))).collect()]


HEX32 = "a1" * 16
MASK_CASES = {
    "é10.0.0.1é": "é[IP_REDACTED]é",
    "x10.0.0.1": "x10.0.0.1",
    "10.0.0.1.5": "[IP_REDACTED].5",
    "1.2.3.4_": "1.2.3.4_",
    "10.0.0.1234": "10.0.0.1234",
    "..a@b.co": "..[EMAIL_REDACTED]",
    "a@b.c|d": "[EMAIL_REDACTED]",
    "a@b.co%c@d.org x": "[EMAIL_REDACTED][EMAIL_REDACTED] x",
    "%c@d.org": "%[EMAIL_REDACTED]",
    "password:\nvalue rest": "password=[SECRET_REDACTED] rest",
    "KEY=abc,def": "KEY=[SECRET_REDACTED],def",
    "mytoken=abckey=def ok": "mytoken=[SECRET_REDACTED] ok",
    "Secret: x;Passwd=y": "Secret=[SECRET_REDACTED];Passwd=[SECRET_REDACTED]",
    "token = abc": "token = abc",
    HEX32[:31]: HEX32[:31],
    HEX32: "[SECRET_REDACTED]",
    "-" + HEX32 + HEX32 + "-": "-[SECRET_REDACTED]-",
    "": "",
    None: None,
}


def test_mask_edges(spark):
    assert apply(spark, list(MASK_CASES), mask) == list(MASK_CASES.values())


def test_mask_equals_re2_on_random_texts(spark):
    import duckdb

    from faultlens.plans.catalog import sql

    rng = random.Random(7)
    parts = ["10.0.0.1", "a@b.co", "x|y", "token", "key", "=", ":", " ", "\n", ".", "%", "_", "é", "9", "Z", "@", ",", ";",
             HEX32, "secret", "ſecret", "PASSWORD", "-", "+", "1.2.3.4.5", "c.d", " ", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INT, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(texts)))
    want = [r[0] for r in con.execute(f"SELECT {sql.mask('t')} FROM x ORDER BY i").fetchall()]
    assert apply(spark, texts, mask) == want


def test_mask_is_idempotent(spark):
    once = apply(spark, [t for t in MASK_CASES if t], mask)
    assert apply(spark, once, mask) == once


def test_mask_long_run_is_linear(spark):
    long = "ab.cd-" * 200_000
    assert apply(spark, [long + "@"], mask) == [long + "@"]


def test_line_weight(spark):
    cases = {
        "ERROR and DEBUG": 1.0, "  debug detail": 0.8, "Caused by: nothing": 0.1, "at x FATAL": 1.0,
        "\ttrace": 0.8, "warning": 0.6, "some exception": 0.9, "at info": 0.8, "plain": 0.1, "": 0.1, "info": 0.2,
    }
    assert apply(spark, list(cases), line_weight) == list(cases.values())


def reference_truncate(text: str, max_tokens: int) -> str:
    """Plain restatement of the line choice for brute-force comparison."""
    def weight(line):
        level = max([w for k, w in fv.LEVEL_WEIGHTS.items() if k in line.upper()], default=None)
        if level is None:
            return fv.NO_LEVEL_WEIGHT
        return max(level, 0.8) if line.startswith(tuple(fv.DETAIL_PREFIXES)) else level

    lines, limit = text.split("\n"), max_tokens * 3
    n = len(lines)
    kept = {i for i in range(n) if i < 3 or (i >= n - 3 and n >= 3)}
    used = sum(len(lines[i].encode()) + 1 for i in kept)
    for i in sorted(range(n), key=lambda i: (-weight(lines[i]), i)):
        size = len(lines[i].encode())
        if i not in kept and used + size <= limit:
            kept.add(i)
            used += size + 1
    return "\n".join(lines[i] for i in sorted(kept))


def test_truncate_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["ERROR", "warn", "info", "  at debug", "plain", "é" * 5, "x" * 40, "", "Caused by: exception"]
    texts = ["\n".join(rng.choice(words) + str(rng.randint(0, 9)) * rng.randint(0, 20) for _ in range(n))
             for n in [1, 1, 2, 3, 4, 5, 6, 7, 8, 12, 20, 40] for _ in range(15)] + ["", "\n\n\n\n\n\n\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for max_tokens in (1, 20, 60, 150):
        got = [r.s for r in pp.truncate_lines(df, "t", "s", max_tokens).orderBy("i").collect()]
        assert got == [reference_truncate(t, max_tokens) for t in texts]


def test_truncate_keeps_later_short_lines(spark):
    text = "\n".join(["h1", "h2", "h3", "ERROR " + "x" * 50, "ERROR ok", "t1", "t2", "t3"])
    got = pp.truncate_lines(spark.createDataFrame([(text,), (None,)], "t string"), "t", "s", 13).collect()
    assert got[0].s.split("\n") == ["h1", "h2", "h3", "ERROR ok", "t1", "t2", "t3"]
    assert got[1].s is None


def test_key_errors(spark):
    every = " ".join(fv.KEY_ERRORS)
    got = apply(spark, [every, "cpu 100%", "acceß denied", "ACCEſS DENIED", "nothing", None], key_errors)
    assert got == [fv.KEY_ERRORS[:10], ["CPU"], [], ["Access denied"], [], []]


def reference_keywords(text):
    upper = text.upper()
    found = [p for p in fv.KEY_ERRORS if p.upper() in upper][:10] + [p for p in fv.RETRIEVAL_WORDS if p.upper() in upper]
    out = []
    for word in found:
        if word.upper() not in [w.upper() for w in out]:
            out.append(word)
    return out or fv.DEFAULT_WORDS


def test_retrieval_keywords(spark):
    rng = random.Random(5)
    pool = fv.KEY_ERRORS + fv.RETRIEVAL_WORDS
    texts = ["nothing here", " ".join(pool)] + [" ".join(rng.sample(pool, rng.randint(1, 30))) for _ in range(60)]
    got = apply(spark, texts, lambda t: retrieval_keywords(t, key_errors(t)))
    assert got == [reference_keywords(t) for t in texts]


def test_clips_and_hashes(spark):
    texts = ["a" * 120, "a" * 121, "é" * 61, "a" * 119 + "é", "a" * 118 + "漢字", "漢" * 50, "𝄞" * 40, "", None]

    def want(t):
        if t is None or len(t.encode()) <= 120:
            return t
        return t.encode()[:120].decode(errors="ignore") + "..."

    assert apply(spark, texts, lambda t: tx.clip_bytes(t, 120)) == [want(t) for t in texts]
    assert apply(spark, ["漢" * 81, "漢" * 80], lambda t: tx.clip_chars(t, 80)) == ["漢" * 80 + "...", "漢" * 80]
    assert apply(spark, ["abc"], tx.raw_hash_short) == [hashlib.sha256(b"abc").hexdigest()[:32]]
    assert apply(spark, ["漢字a", ""], tx.token_estimate) == [2, 0]
    assert apply(spark, ["Größe É_x 12,3"], tx.tokens) == [["größe", "é", "x", "12", "3"]]


def test_timestamp_range(spark):
    got = apply(spark, ["2024-01-02 03:04:05 x 2024-01-01T00:00:00 y 2024-99-99 00:00:00", "none"], tx.timestamp_range)
    assert str(got[0].start) == "2024-01-01 00:00:00" and str(got[0].end) == "2024-01-02 03:04:05"
    assert got[1].start is None


def test_preprocess_hashes_the_untruncated_masked_text(spark):
    text = "\n".join(["ERROR CPU 10.0.0.1"] * 50)
    row = pp.preprocess(spark.createDataFrame([(text,)], "content string"), max_tokens=20).first()
    masked = text.replace("10.0.0.1", "[IP_REDACTED]")
    assert row.original_hash == hashlib.sha256(masked.encode()).hexdigest()
    assert len(row.processed_text) < len(masked) and row.key_errors == ["CPU"]
    assert row.token_count == len(row.processed_text) // 3


def test_preprocess_plan_has_no_python_and_no_shuffle(spark):
    df = pp.with_keywords(pp.preprocess(spark.createDataFrame([("x",)], "content string")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Exchange", plan)
