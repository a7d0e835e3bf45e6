"""Benchmark decontamination by spaced seeds, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.sources.stage import stage

MASKS = ("1101100101", "111010011", "10110111")  # 1: the word counts, 0: any word may stand there
MIN_WORDS = 13
PENALTY = 4  # a mismatch undoes four matches: a segment is not under 0 while 4 of 5 words agree
SEEDS_AT_ONCE = 1_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words (runs of letters and digits, lower-cased); empty for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: Sequence[str]) -> DataFrame:
    """Adds pos (0-based word) and seed, a row for each place and mask that fits; rows have the word hashes in hs."""
    shortest = min(map(len, masks))
    placed = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("hs") - shortest)))
    seeds = [
        F.when(
            F.col("pos") <= F.size("hs") - len(mask),
            F.xxhash64(F.lit(number), *[F.get("hs", F.col("pos") + j) for j, c in enumerate(mask) if c == "1"]),
        )
        for number, mask in enumerate(masks)
    ]
    return placed.withColumn("seed", F.explode(F.array(*seeds))).filter("seed IS NOT NULL")


def _long_enough(rows: DataFrame, masks: Sequence[str]) -> DataFrame:
    return rows.filter(F.size("hs") >= min(map(len, masks)))


def _best_segment(agree: Column, need: Column, at_first: Column, at_last: Column) -> Column:
    """struct(best, first, last): of the segments of ``need`` words or more that begin and end with a word that agrees, or
    at an end of the item (``at_first``, ``at_last``: agree begins, ends there), the one of most matches less PENALTY per
    mismatch, if that is not under 0; else best is -1. Ties: it ends first, then is shortest."""
    pairs = F.zip_with(agree, F.concat(F.array_repeat(F.lit(False), need - 1), agree), lambda x, y: F.struct(x.alias("now"), y.alias("then")))
    zero, none = F.lit(0), F.lit(2**30)
    names = ("i", "upto", "behind", "low", "since", "best", "first", "last")
    start = F.struct(*(v.alias(n) for n, v in zip(names, (zero, zero, zero, none, zero, F.lit(-1), zero, F.lit(-1)))))
    gain = lambda same: F.when(same, F.lit(1)).otherwise(F.lit(-PENALTY))

    def step(s: Column, x: Column) -> Column:
        begin = s["i"] - need + 1  # the last place a segment that ends here can begin at; behind: the score before it
        enters = (begin >= 0) & (x["then"] | (at_first & (begin == 0))) & (s["behind"] <= s["low"])
        low = F.when(enters, s["behind"]).otherwise(s["low"])
        since = F.when(enters, begin).otherwise(s["since"])
        upto = s["upto"] + gain(x["now"])
        better = (x["now"] | (at_last & (s["i"] == F.size(agree) - 1))) & (upto - low > s["best"])
        values = (
            s["i"] + 1,
            upto,
            s["behind"] + F.when(begin >= 0, gain(x["then"])).otherwise(zero),
            low,
            since,
            F.when(better, upto - low).otherwise(s["best"]),
            F.when(better, since).otherwise(s["first"]),
            F.when(better, s["i"]).otherwise(s["last"]),
        )
        return F.struct(*(v.alias(n) for n, v in zip(names, values)))

    return F.aggregate(F.slice(pairs, 1, F.size(agree)), start, step)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    min_words: int = MIN_WORDS,
    seeds_at_once: int = SEEDS_AT_ONCE,
) -> DataFrame:
    """Overlaps of documents with benchmark items: (doc_id, item_id, text_key, doc_start, item_start, n_words, n_matches).

    Each mask is laid on every word position of every whole text; the words under its ones make a seed. Seeds that
    a document and an item share give a diagonal; along it, document and item are compared word by word, and any
    segment counts that has ``min_words`` words (the whole item, if that is shorter) of which four in five agree, and
    that begins and ends with a word that agrees or at an end of the item. Per row of the documents and item the segment with most matches is returned. Texts and
    items without words, null or shorter than the shortest mask have no seeds and so no overlap.

    Seeds of the benchmark are broadcast in slices of at most ``seeds_at_once`` rows, and the documents are read once
    per slice, so neither texts nor their seeds are shuffled, whatever the size of the benchmark.
    """
    items = _long_enough(benchmark.select("item_id", word_hashes(F.col("text")).alias("hs")), masks)
    items = stage(items.withColumn("item", F.xxhash64("item_id", "hs")).distinct(), "items")
    seeds = stage(_seeds(items, masks).select("seed", "item", F.col("pos").alias("item_pos"), F.size("hs").alias("n_item")), "seeds")
    n_slices = max(1, -(-seeds.count() // seeds_at_once))
    texts = _long_enough(
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), word_hashes(F.col("text")).alias("hs")), masks
    )
    placed = _seeds(texts, masks)
    at = F.col("pos") - F.col("item_pos")
    skip = F.greatest(at, F.lit(0))
    hits = [
        placed.join(F.broadcast(seeds.filter(F.pmod("seed", F.lit(n_slices)) == k)), "seed").select(
            "doc_id",
            "text_key",
            "item",
            at.alias("at"),
            F.slice("hs", skip + 1, F.least(F.col("n_item") + F.least(at, F.lit(0)), F.size("hs") - skip)).alias("part"),
        )
        for k in range(n_slices)
    ]
    diagonals = reduce(DataFrame.unionByName, hits).distinct()
    beside = F.slice("hs", F.greatest(-F.col("at"), F.lit(0)) + 1, F.size("part"))
    agreeing = diagonals.join(items, "item").select(
        "doc_id", "text_key", "item_id", "item", "at", F.size("hs").alias("n_item"),
        F.zip_with("part", beside, lambda x, y: x == y).alias("agree"),
    )
    need = F.least(F.lit(min_words), F.col("n_item"))
    at_last = F.size("agree") + F.greatest(-F.col("at"), F.lit(0)) == F.col("n_item")
    compared = agreeing.filter(F.size("agree") >= need).withColumn("s", _best_segment(F.col("agree"), need, F.col("at") >= 0, at_last))
    n_words = F.col("s.last") - F.col("s.first") + 1
    found = compared.select(
        "doc_id", "text_key", "item_id", "item", "n_item",
        n_words.alias("n_words"),
        ((F.col("s.best") + PENALTY * n_words) / (PENALTY + 1)).cast("int").alias("n_matches"),
        (F.col("s.first") + F.greatest("at", F.lit(0))).alias("doc_start"),
        (F.col("s.first") + F.greatest(-F.col("at"), F.lit(0))).alias("item_start"),
        F.col("s.best").alias("score"),
    ).filter("score >= 0")
    best = F.max(F.struct("n_matches", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "n_words")).alias("b")
    return found.groupBy("doc_id", "text_key", "item_id", "item").agg(best).select(
        "doc_id", "item_id", "text_key",
        (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), "b.n_words", "b.n_matches",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that overlap a benchmark item; columns are kept as they are.

    Documents are told apart by their whole text, so null and repeated ids are treated right.
    """
    found = stage(overlaps(docs, benchmark, **options).select(F.col("text_key").alias("_text_key")).distinct(), "leaks")
    return docs.join(found, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_text_key"], "left_anti")
