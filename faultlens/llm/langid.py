"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.tables import fold
from faultlens.llm.textops import slices

ORDERS = (1, 2, 3)
BITS = 16
SMOOTHING = 0.5
MAX_LANGS = 200
UNKNOWN = "und"
_SPACE = 32


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


_ALPHA: list[np.ndarray] = []


def _alpha(points: np.ndarray) -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(_letters())
    return _ALPHA[0][points]


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, the text each belongs to, and whether each text has a letter.

    Texts are lower-cased; every run of other characters is one blank, and a text begins and ends with one.
    """
    joined = "\0".join([" " + t.replace("\0", " ").lower() + " " for t in texts]) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 0
    plain = np.where(_alpha(points), points, np.uint32(_SPACE))
    plain[ends] = 0
    keep = np.ones(len(plain), bool)
    keep[1:] = ~((plain[1:] == _SPACE) & (plain[:-1] == _SPACE))
    plain = plain[keep]
    text = np.cumsum(plain == 0) - (plain == 0)
    with_letter = np.bincount(text, weights=plain > _SPACE, minlength=len(texts)) > 0
    whole = plain != 0
    buckets, owner = [], []
    for order in ORDERS:
        n = len(plain) - order + 1
        if n <= 0:
            continue
        h, ok = np.full(n, order, np.uint32), np.ones(n, bool)
        for j in range(order):
            h = (h ^ plain[j:j + n]) * np.uint32(0x01000193)
            ok &= whole[j:j + n]
        if order == 1:
            ok &= plain != _SPACE
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
        buckets.append(h[ok])
        owner.append(text[:n][ok])
    return np.concatenate(buckets), np.concatenate(owner), with_letter


def _strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Per task: n-gram counts of each language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = _strings(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
        for start, end in slices(map(len, texts), 500_000):
            bucket, owner, _ = grams(texts[start:end], bits)
            for lang in set(langs[start:end]):
                mine = (langs[start:end] == lang)[owner]
                if lang not in counts:
                    if len(counts) >= MAX_LANGS:
                        raise ValueError(f"more than {MAX_LANGS} languages")
                    counts[lang] = np.zeros(1 << bits, np.int64)
                counts[lang] += np.bincount(bucket[mine], minlength=1 << bits)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"]
        )


@dataclass
class Model:
    langs: list[str]
    priors: np.ndarray  # by language
    weights: np.ndarray  # buckets x languages, log-probabilities


def train(docs: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> Model:
    """docs(text, lang), lang not null. The matrix has 2**bits rows and at most ``MAX_LANGS`` columns."""
    rows = docs.filter("lang IS NOT NULL").select("text", F.col("lang").cast("string"))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(shares) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(shares)
    counts = np.zeros((1 << bits, len(langs)))
    summed = rows.mapInArrow(lambda b: _count(b, bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for lang, part in summed.toPandas().groupby("lang") if langs else ():
        counts[part["bucket"].to_numpy(), langs.index(lang)] = part["n"].to_numpy()
    weights = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * (1 << bits))) if langs else counts
    total = sum(shares.values())
    return Model(langs, np.log(np.array([shares[x] / total for x in langs])), weights.astype(np.float32))


def predict_texts(texts: list[str], model: Model, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bucket, owner, with_letter = grams(texts, bits)
    logs = np.stack(
        [np.bincount(owner, weights=model.weights[bucket, k], minlength=len(texts)) for k in range(len(model.langs))], axis=1
    ) + model.priors
    best = logs.argmax(axis=1)
    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, with_letter)]
    return names, np.where(with_letter, share, 0.0)


def identify(docs: DataFrame, held: int = 4, held_rest: int = 2, bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of the documents.

    Learns from the rows outside the held-out fold that name a language. A text that is null or has no letter is
    ``und`` with score 0, and so is every text where nothing could be learned; the score of others is the posterior
    probability of the language named. Equal languages in probability: the first by name.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), (fold(F.col("doc_id"), held) == held_rest).alias("held_out"), "text", "lang"
    )
    model = train(rows.filter("NOT held_out"), bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            texts = _strings(batch.column("text"))
            names, scores = [], []
            for start, end in slices(map(len, texts), 500_000):
                found, share = predict_texts(texts[start:end], shared.value, bits)
                names += found
                scores.append(share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate([*scores, []]), pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.drop("lang").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
