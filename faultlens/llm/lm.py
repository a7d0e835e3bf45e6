"""Language-model scores: deleted interpolation of word n-grams, weights by expectation-maximisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.tables import fold
from faultlens.llm.textops import blobs, hashed, mix
from faultlens.session import work_path

BLOCK_BYTES = 6_000_000
BLOCKS_PER_SHARD = 3
BUCKETS = 24  # contexts by the power of two of their frequency
STEPS = 4  # cells per power of two in the held-out counts
EM_ROUNDS = 100
_END = np.uint64(xxhash.xxh64_intdigest(b""))
_ODD = np.uint64(1)
_TYPES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "c1": pa.list_(pa.int64()), "c2": pa.list_(pa.int64()),
          "cells": pa.list_(pa.int32()), "n": pa.list_(pa.int64()), "stats": pa.list_(pa.int64())}
_PROFILE = "doc_id long, held_out boolean, c1 array<long>, c2 array<long>, cells array<int>, n array<long>, stats array<long>"


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word key and word-pair key of each token, and the bounds of each text; every text closes with an end token.

    The token before a text's first is an end token too. Word keys are odd, pair keys even.
    """
    h, bounds = hashed(texts)
    ends = bounds[1:]
    tokens = np.insert(h, ends, _END)
    bounds = bounds + np.arange(len(bounds))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = _END
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(tokens))
    return tokens | _ODD, pair & ~_ODD, bounds


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys (one at least): the first, then differences of equal width."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    width = blob[0]
    wide = np.zeros(((len(blob) - 9) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1, 1), wide.view("<u8").ravel()]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte per count; 255 stands for the next of the large ones, which follow."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(small).to_bytes(8, "little") + small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=8 + n)
    return out


def _edges(n_shards: int) -> np.ndarray:
    return np.array([(i << 64) // n_shards for i in range(1, n_shards)], np.uint64)


def _ask(group: pa.Table, n_shards: int) -> pa.Table:
    """A block's distinct keys, cut by shard, with their counts in its training texts."""
    table = group.combine_chunks()
    block = table.column("block")[0].as_py()
    word, pair, bounds = _keys(blobs(table.column("text").combine_chunks()))
    learn = np.repeat(~table.column("held_out").to_numpy(), np.diff(bounds))
    keys, inverse = np.unique(np.concatenate([word, pair]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([learn, learn]), minlength=len(keys)).astype(np.int64)
    cuts = [0, *np.searchsorted(keys, _edges(n_shards)), len(keys)]
    rows = [(s, block, pack_keys(keys[i:j]), pack_counts(counts[i:j])) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["shard", "block", "keys", "counts"])


def _serve(group: pa.Table) -> pa.Table:
    """Sums the counts of a shard's keys over all blocks, and sends every block those it asked for.

    A further row (block -1) has the shard's number of training tokens and of words seen in training.
    """
    shard = group.column("shard")[0].as_py()
    asked = [unpack_keys(k) for k in group.column("keys").to_pylist()]
    mine = [unpack_counts(c) for c in group.column("counts").to_pylist()]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(mine), minlength=len(keys)).astype(np.int64)
    answers = np.split(total[inverse], np.cumsum([len(a) for a in asked])[:-1])
    words = total[(keys & _ODD) == 1]
    stats = np.array([words.sum(), (words > 0).sum()])
    blocks = [*group.column("block").to_pylist(), -1]
    return pa.table([pa.array(blocks, pa.int64()), pa.array([shard] * len(blocks), pa.int64()), pa.array([pack_counts(a) for a in [*answers, stats]], pa.binary())],
                    names=["block", "shard", "answer"])


def _steps(x: np.ndarray) -> np.ndarray:
    """0 for nothing, else 1 + the rounded logarithm in steps (shifted so that small ratios stay positive)."""
    out = np.zeros(len(x), np.int64)
    some = x > 0
    out[some] = 1 + np.rint(STEPS * (np.log2(x[some]) + 48)).astype(np.int64)
    return out


_SPAN = 1 + 96 * STEPS + 1


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def _profile(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Per text the corpus counts of its words and pairs; per block the held-out counts for the weights.

    Held-out means deleted: a training text is looked at with its own counts taken away.
    """
    out = {c: [] for c in _TYPES}

    def add(**values):
        for c in out:
            out[c].append(values.get(c))

    order = np.argsort(answers.column("shard").to_numpy(), kind="stable") if answers.num_rows else []
    parts = answers.column("answer").to_pylist()
    if not texts.num_rows:
        for i in order:
            add(stats=unpack_counts(parts[i]))
    else:
        total = np.concatenate([unpack_counts(parts[i]) for i in order])
        word, pair, bounds = _keys(blobs(texts.column("text").combine_chunks()))
        keys, inverse = np.unique(np.concatenate([word, pair]), return_inverse=True)
        c1, c2 = total[inverse[:len(word)]], total[inverse[len(word):]]
        doc_ids, held = texts.column("doc_id").to_pylist(), texts.column("held_out").to_numpy()
        for i, (start, end) in enumerate(zip(bounds, bounds[1:])):
            add(doc_id=doc_ids[i], held_out=bool(held[i]), c1=c1[start:end], c2=c2[start:end])
        owner = np.repeat(np.arange(len(held)), np.diff(bounds))
        own = np.concatenate([owner, owner]) * len(keys) + inverse
        _, back, times = np.unique(own, return_inverse=True, return_counts=True)
        own1, own2 = times[back[:len(word)]], times[back[len(word):]]
        learn = ~held[owner]
        left1, left2 = (c1 - own1)[learn], (c2 - own2)[learn]
        before = np.empty_like(c1)
        before[1:] = (c1 - own1)[:-1]
        before[bounds[:-1]] = (c1 - own1)[bounds[1:] - 1]
        before = before[learn]
        ratio = np.divide(left2, before, out=np.zeros(len(before)), where=before > 0)
        cell = (_bucket(before) * _SPAN + _steps(ratio)) * _SPAN + _steps(left1.astype(float))
        cells, n = np.unique(cell, return_counts=True)
        add(cells=cells.astype(np.int32), n=n.astype(np.int64))
    return pa.table([pa.array(out[c], t) for c, t in _TYPES.items()], names=list(_TYPES))


def fit_weights(cells: np.ndarray, n: np.ndarray, n_tokens: int, n_types: int) -> np.ndarray:
    """Weights (bucket x [uniform, word, pair]) by expectation-maximisation over the held-out counts."""
    value = lambda q: np.where(q > 0, 2.0 ** ((q - 1) / STEPS - 48), 0.0)
    bucket = cells // _SPAN // _SPAN
    parts = np.stack([
        np.full(len(cells), 1.0 / (n_types + 1)), value(cells % _SPAN) / max(1, n_tokens), value(cells // _SPAN % _SPAN)
    ], axis=1)
    if not len(cells):  # nothing to learn from: the uniform estimate alone
        return np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    weights = np.tile([0.1, 0.5, 0.4], (BUCKETS, 1))
    for _ in range(EM_ROUNDS):
        share = weights[bucket] * parts
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + np.array([0.2, 0.5, 0.3])
        new /= new.sum(axis=1, keepdims=True)
        done = abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    return weights


def score_texts(c1: list[np.ndarray], c2: list[np.ndarray], weights: np.ndarray, n_tokens: int, n_types: int):
    """Per text: tokens, known tokens, base score and model score (log10)."""
    out = []
    for words, pairs in zip(c1, c2):
        before = np.concatenate([words[-1:], words[:-1]])
        mixed = weights[_bucket(before)]
        ratio = np.divide(pairs, before, out=np.zeros(len(pairs)), where=before > 0)
        p = mixed[:, 0] / (n_types + 1) + mixed[:, 1] * words / max(1, n_tokens) + mixed[:, 2] * ratio
        base = np.log10((words + 1) / (n_tokens + n_types + 1)).sum()
        out.append((len(words), int((words > 0).sum()), float(base), float(np.log10(p).sum())))
    return out


def score(docs: DataFrame, held: int = 7, held_rest: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of the documents.

    Tokens are the words between ASCII blanks with A-Z lower-cased, and one end token per text; a null text is
    empty and has the end token alone. Training texts are those outside the held-out fold. ``base_score`` uses add-one
    word counts. ``score`` mixes the uniform, word and word-pair estimates with weights by the frequency of the
    word before; they are learned on all training texts, each with its own counts deleted. Repeated rows count
    as often as they occur. Without training texts both scores are 0.

    Texts are dealt to blocks of about ``block_bytes``. A block sends each of its distinct keys once to the shard that
    owns the key, so a word in every text arrives once per block; the shard adds up and answers. Words and
    pairs are told apart by 64-bit hashes. Counts are never gathered anywhere but in their shards.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), held) == held_rest).alias("held_out"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_blocks = max(1, -(-size // block_bytes))
    n_shards = -(-n_blocks // BLOCKS_PER_SHARD)
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks))).select("block", "doc_id", "held_out", "text")
    asked = texts.groupBy("block").applyInArrow(lambda t: _ask(t, n_shards), "shard long, block long, keys binary, counts binary")
    answers = asked.groupBy("shard").applyInArrow(_serve, "block long, shard long, answer binary")
    profile = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_profile, _PROFILE)
    path = work_path(docs.sparkSession, "lm-profile")
    profile.write.option("compression", "zstd").parquet(path)
    profile = docs.sparkSession.read.schema(profile.schema).parquet(path)

    sums = profile.filter("stats IS NOT NULL").agg(F.sum(F.col("stats")[0]).alias("tokens"), F.sum(F.col("stats")[1]).alias("types")).first()
    n_tokens, n_types = sums["tokens"] or 0, sums["types"] or 0
    counts = (
        profile.filter("cells IS NOT NULL").select(F.explode(F.arrays_zip("cells", "n")).alias("z"))
        .groupBy("z.cells").agg(F.sum("z.n").alias("n")).toPandas()
    )
    weights = fit_weights(counts["cells"].to_numpy(), counts["n"].to_numpy(), n_tokens, n_types)

    def rate(batches):
        for batch in batches:
            arrays = []
            for c in ("c1", "c2"):
                column = batch.column(c)
                flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
                arrays.append([flat[i:j] for i, j in zip(ends, ends[1:])])
            rows = score_texts(*arrays, weights, n_tokens, n_types)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)),
                 pa.array([n_tokens] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return profile.filter("c1 IS NOT NULL").select("doc_id", "held_out", "c1", "c2").mapInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
