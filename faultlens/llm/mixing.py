"""Mixing sources to target weights: temperature exponent, then budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.llm.tables import count_words, hash32
from faultlens.sources.stage import stage

STEPS = 60
MAX_SOURCES = 100_000
BLOCK_TOKENS = 1_000_000


@dataclass
class Mix:
    """Solved weights: exponent, budget, and the share and token target of each source (in the order given)."""

    exponent: float
    budget: float
    weights: np.ndarray
    targets: np.ndarray


def _weights(tokens: np.ndarray, exponent: float) -> np.ndarray:
    powered = np.where(tokens > 0, np.power(np.maximum(tokens, 1) / max(tokens.sum(), 1), exponent), 0.0)
    return powered / max(powered.sum(), 1e-300)


def _budget(tokens: np.ndarray, weights: np.ndarray, budget: float | None) -> float:
    """The given budget, else the smallest that passes over every source once at least."""
    if budget is not None:
        return float(budget)
    used = weights > 0
    return float((tokens[used] / weights[used]).max()) if used.any() else 0.0


def solve(
    tokens: np.ndarray, target_entropy: float | None, max_repetition: float | None, budget: float | None = None
) -> Mix:
    """Bisects the exponent in [0, 1]; 1 keeps the natural shares, 0 makes all sources equal.

    ``target_entropy`` is a share of the largest possible entropy: the largest exponent that still reaches it is
    taken. ``max_repetition`` bounds how often a source is passed over: the exponent is raised until no source
    is used more often. Where both are given and disagree, the repetition limit wins.
    """
    used = tokens[tokens > 0].astype(float)

    def entropy(exponent: float) -> float:
        w = _weights(used, exponent)
        return float(-(w * np.log(w)).sum())

    def repetition(exponent: float) -> float:
        w = _weights(used, exponent)
        return float((w * _budget(used, w, budget) / used).max())

    exponent = 1.0
    if target_entropy is not None and len(used) > 1 and entropy(1.0) < target_entropy * np.log(len(used)):
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mid) >= target_entropy * np.log(len(used)) else (low, mid)
        exponent = low
    if max_repetition is not None and len(used) and repetition(exponent) > max_repetition:
        low, high = exponent, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if repetition(mid) <= max_repetition else (mid, high)
        exponent = high
    weights = _weights(tokens.astype(float), exponent)
    total = _budget(tokens.astype(float), weights, budget)
    return Mix(exponent, total, weights, np.rint(weights * total).astype(np.int64))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of documents; a null or empty text has no tokens."""
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("n_tokens"))


def _keys(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Adds the number and order key of each row's block, and the row's own order key."""
    keyed = rows.withColumn("_skey", _source_key(F.col("source"))).join(F.broadcast(plan), "_skey")
    block = F.pmod(hash32(F.lit(f"{seed}b"), F.col("doc_id")), F.col("_n_blocks"))
    return (
        keyed.withColumn("_block", block)
        .withColumn("_block_key", hash32(F.lit(f"{seed}o"), F.col("_skey"), F.col("_block")))
        .withColumn("_doc_key", hash32(F.lit(f"{seed}d"), F.col("doc_id")))
    )


def mixing_plan(
    tokens: DataFrame,
    target_entropy: float | None,
    max_repetition: float | None,
    budget: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 7,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """One row per source that says which of its documents are taken how often.

    Each source fills its token target with whole passes, then with a permutation of its blocks: blocks come in
    the order of a hash, whole blocks are taken while they fit, and of the first that does not fit the documents
    in hash order while they fit. Only that one block per source is ordered by documents, so no source is ever
    sorted as a whole; what leaves is the cut of each source, not lists of documents. The plan has a row per
    source; more than ``max_sources`` sources raise an error.
    """
    spark = tokens.sparkSession
    totals = tokens.groupBy(_source_key(F.col("source")).alias("_skey")).agg(F.sum("n_tokens").alias("n")).limit(max_sources + 1)
    sources = sorted((r["_skey"], r["n"] or 0) for r in totals.collect())
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = np.array([n for _, n in sources], np.int64)
    mix = solve(sizes, target_entropy, max_repetition, budget)
    rows = [
        (key, float(w), int(t // n) if n else 1, int(t % n) if n else 0, max(1, -(-n // block_tokens)))
        for (key, n), w, t in zip(sources, mix.weights.tolist(), mix.targets.tolist())
    ]
    plan = spark.createDataFrame(rows, "_skey string, _weight double, _passes long, _rest long, _n_blocks long")

    keyed = _keys(tokens, plan, seed)
    blocks = keyed.groupBy("_skey", "_block", "_block_key", "_rest").agg(F.sum("n_tokens").alias("n"))
    in_order = Window.partitionBy("_skey").orderBy("_block_key", "_block")
    blocks = blocks.withColumn("after", F.sum("n").over(in_order))
    # the first block that does not fit; none where the rest of a pass is nothing or everything
    cut = (
        blocks.filter("after > _rest")
        .groupBy("_skey")
        .agg(F.min(F.struct("_block_key", "_block", (F.col("_rest") - F.col("after") + F.col("n")).alias("room"))).alias("c"))
        .select("_skey", F.col("c._block_key").alias("_cut_key"), F.col("c._block").alias("_cut_block"), F.col("c.room").alias("_room"))
    )
    cut = stage(cut, "cut")
    inside = keyed.join(F.broadcast(cut), "_skey").filter("_block = _cut_block")
    by_doc = Window.partitionBy("_skey").orderBy("_doc_key", "doc_id")
    last = (
        inside.withColumn("after", F.sum("n_tokens").over(by_doc))
        .filter("after <= _room")
        .groupBy("_skey")
        .agg(F.max(F.struct("_doc_key", "doc_id")).alias("_last"))
    )
    return stage(plan.join(cut, "_skey", "left").join(last, "_skey", "left"), "mixing-plan")


def apply_plan(rows: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """Adds copies (how often the row is taken), block and source_weight to rows with doc_id and source.

    One lookup per row in the broadcast plan (a row per source, its number is bounded by the plan), no shuffle.
    """
    keyed = _keys(rows, plan, seed)
    before = (F.col("_block_key") < F.col("_cut_key")) | (
        (F.col("_block_key") == F.col("_cut_key")) & (F.col("_block") < F.col("_cut_block"))
    )
    on_cut = (F.col("_block") == F.col("_cut_block")) & (
        F.struct("_doc_key", "doc_id") <= F.col("_last")
    )
    # a source whose rest covers all its blocks has no cut; that only happens when it holds no tokens
    taken = F.coalesce(before | on_cut, F.lit(False))
    return (
        keyed.withColumn("copies", (F.col("_passes") + taken.cast("long")).cast("int"))
        .withColumn("block", F.col("_block"))
        .withColumn("source_weight", F.round("_weight", 6))
        .drop(*[c for c in keyed.columns if c.startswith("_") and c not in rows.columns])
    )


def mix_report(docs: DataFrame, target_entropy: float = 0.95, max_repetition: float = 4.0, budget: float | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies, block, source_weight), a row for each row of the documents.

    Rows with a null source form a source of their own; a source without tokens is taken once. Repeated rows
    are rows like others: equal ids share their place in the order and are taken or left together.
    """
    tokens = stage(token_table(docs), "tokens")
    plan = mixing_plan(tokens, target_entropy, max_repetition, budget, seed=seed)
    return apply_plan(tokens, plan, seed).select("doc_id", "source", "n_tokens", "copies", "block", "source_weight")


def mix_documents(docs: DataFrame, target_entropy: float = 0.95, max_repetition: float = 4.0, budget: float | None = None, seed: int = 7) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; all columns are kept as they are."""
    names = docs.columns
    tokens = stage(token_table(docs), "tokens")
    plan = mixing_plan(tokens, target_entropy, max_repetition, budget, seed=seed)
    packed = docs.select("doc_id", "source", F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"))
    taken = apply_plan(packed, plan, seed).withColumn("_again", F.explode(F.sequence(F.lit(1), "copies")))
    return taken.filter("_again <= copies").select(*[F.col("_row")[c].alias(c) for c in names])
