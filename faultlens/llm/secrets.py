"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

DataFrame functions only. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.llm.tables import smallest_hashes
from faultlens.sources.stage import stage

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the run in whole, so shorter runs fail as they must
HEX = "[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "markov")

RUN_LENGTH = 20
RUN = f"[A-Za-z0-9_+/=-]{{{RUN_LENGTH},}}"  # what the models look at
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"
SAMPLE_DOCS = 2000
MARGIN = 12.0  # log-likelihood ratio (nats) from which a run counts as random
SMOOTHING = 0.5
BACKOFF = 5.0  # weight, in pairs, of the distribution that unseen pairs fall back on
UNIFORM = 0.5  # share of the uniform distribution in the model of random strings
_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"


def _clean(text: Column) -> Column:
    """The text with the two marks below replaced by a third; no pattern holds any of them."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, _OTHER + _OTHER)


def _matches(clean: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of the leftmost matches that do not overlap."""
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]")
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("found"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        hit = F.struct(state["at"].alias("start"), end.alias("end"), piece.alias("s"))
        return F.struct(
            end.alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(state["inside"], F.concat(state["found"], F.array(hit))).otherwise(state["found"]).alias("found"),
        )

    # most texts have no match: those skip the marking
    return F.when(F.rlike(clean, F.lit(pattern)), F.aggregate(pieces, start, step, lambda s: s["found"])).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, runs): matches per kind, and the runs that the models look at."""
    clean = docs.select("doc_id", _clean(F.col("text")).alias("clean"))
    found = clean.select(
        "doc_id",
        _matches(F.col("clean"), ASSIGN).alias("assign"),
        _matches(F.col("clean"), ACCESS).alias("access"),
        _matches(F.col("clean"), HEX).alias("hex"),
        _matches(F.col("clean"), RUN).alias("runs"),
    )
    value = lambda m: F.regexp_extract(m["s"], ASSIGN, 2)
    return found.withColumn("assign", F.filter("assign", lambda m: F.length(value(m)) >= MIN_ASSIGNED))


def _pairs(strings: DataFrame) -> DataFrame:
    """(label, pair, n) over strings(label, s): characters and what follows them."""
    chars, n = F.split("s", ""), F.length("s") - 1
    each = F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))
    return strings.filter("length(s) > 1").select("label", F.explode(each).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def labelled_samples(docs: DataFrame, spans: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(label, s). 1: all strings that the base patterns caught (assigned values only where they mix in digits);
    0: words of at most ``sample_docs`` documents, those of smallest id hash, without what the patterns catch and
    without runs as long as those that the models are asked about."""
    value = F.transform("assign", lambda m: F.regexp_extract(m["s"], ASSIGN, 2))
    mixed = F.filter(value, lambda s: (F.length(s) >= 16) & F.rlike(s, F.lit("[0-9]")) & F.rlike(s, F.lit("[A-Za-z]")))
    caught = F.concat(mixed, F.col("access.s"), F.col("hex.s"))
    secrets = spans.select(F.lit(1).alias("label"), F.explode(caught).alias("s"))
    some = smallest_hashes(docs.select("doc_id", "text"), ["doc_id"], sample_docs)
    rest = _clean(F.col("text"))
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, F.lit(pattern), F.lit(" "))
    plain = some.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9_+/=-]{3,}"), F.lit(0))).alias("s"))
    return secrets.unionByName(plain.filter(F.length("s") < RUN_LENGTH))


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio (random to ordinary) of each pair of characters; None without samples of both labels.

    The table has a cell per pair of characters of the fixed alphabet (0: any other), whatever the sample.
    """
    size = len(ALPHABET) + 1
    counts = [[0.0] * (size * size) for _ in range(2)]
    rows = _pairs(samples).filter(F.rlike("pair", F.lit("^[A-Za-z0-9_+/=-]{2}$"))).collect()
    for label, pair, n in rows:
        a, b = ALPHABET.index(pair[0]) + 1, ALPHABET.index(pair[1]) + 1
        counts[label][a * size + b] += n
    if not all(map(sum, counts)):
        return None
    # pairs that were not seen fall back on how frequent the second character is
    single = [[sum(c[b::size]) + SMOOTHING for b in range(size)] for c in counts]
    single = [[x / sum(s[1:]) for x in s] for s in single]
    ratio = [0.0] * (size * size)
    for a in range(1, size):
        total = [sum(c[a * size + 1:(a + 1) * size]) + BACKOFF for c in counts]
        for b in range(1, size):
            ordinary, random = ((c[a * size + b] + BACKOFF * s[b]) / t for c, s, t in zip(counts, single, total))
            ratio[a * size + b] = math.log((1 - UNIFORM) * random + UNIFORM / (size - 1)) - math.log(ordinary)
    return ratio


def log_ratio(s: Column, ratio: list[float]) -> Column:
    """Sum of the pair ratios along the string."""
    size, cells = len(ALPHABET) + 1, F.expr("array(" + ",".join(f"{x!r}D" for x in ratio) + ")")
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))

    def step(state: Column, char: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), char)
        return F.struct(at.alias("before"), (state["sum"] + F.get(cells, state["before"] * size + at)).alias("sum"))

    # cells of row 0 (no character before) are 0
    return F.aggregate(F.split(s, ""), start, step, lambda state: state["sum"])


def scan(docs: DataFrame, margin: float = MARGIN, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov), a row for each row of the documents.

    The models add runs that have a digit and a letter, touch no base span and are at least ``margin`` nats likelier
    as random strings. ``spans`` joins kind:start:end by start and kind; it is empty, and base_sha256 the hash of
    the empty text, where nothing is found or the text is null or empty. Without samples of both labels nothing is added.
    """
    spans = stage(base_spans(docs), "secret-spans")
    ratio = train(labelled_samples(docs, spans, sample_docs))
    kinds = ["assign", "access", "hex"]
    tagged = lambda name, k: F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))
    base = spans.withColumn("base", F.array_sort(F.concat(*[tagged(name, k) for k, name in enumerate(kinds)])))
    if ratio is None:
        added = F.array().cast("array<struct<start:int,k:int,end:int>>")
    else:
        random = F.filter(
            "runs",
            lambda r: F.rlike(r["s"], F.lit("[0-9]")) & F.rlike(r["s"], F.lit("[A-Za-z]"))
            & ~F.exists("base", lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"]))
            & (log_ratio(r["s"], ratio) >= margin),
        )
        added = F.transform(random, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("k"), m["end"].alias("end")))
    rows = base.withColumn("added", added)
    name = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", F.get(name, m["k"]), m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )
