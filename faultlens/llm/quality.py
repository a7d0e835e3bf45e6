"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.tables import fold
from faultlens.llm.textops import blobs
from faultlens.sources.stage import stage

FEATURES = (
    "log_words", "word_length", "upper", "digits", "sentence_marks", "loud_marks", "symbols", "bars", "newlines",
    "blanks", "other_bytes", "byte_entropy", "distinct_words", "repeated_words", "distinct_lines", "longest_word",
)
POOLED = 0.1
RIDGE = 0.02
CLIP = 60.0
GRID = 10  # cells per unit of log-density difference in the calibration counts
_SCHEMA = "doc_id long, held_out boolean, x array<double>"


def _class_of_bytes() -> np.ndarray:
    """0 others, 1 upper, 2 lower, 3 digit, 4 . , ; : ? ' " ( ) -, 5 !, 6 symbols, 7 |, 8 newline, 9 blank, 10 continuation."""
    kind = np.zeros(256, np.int64)
    kind[ord("A"):ord("Z") + 1], kind[ord("a"):ord("z") + 1], kind[ord("0"):ord("9") + 1] = 1, 2, 3
    for group, chars in ((4, ".,;:?'\"()-"), (5, "!"), (6, "#$%&*+/<=>@[]\\^_`{}~"), (7, "|"), (8, "\n"), (9, " \t\r\v\f")):
        for c in chars:
            kind[ord(c)] = group
    kind[0x80:0xC0] = 10
    return kind


_KINDS = _class_of_bytes()


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text, in the order of ``FEATURES``; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = np.bincount(_KINDS, weights=by_byte, minlength=11)
    chars = max(1.0, n.sum() - n[10])
    share = by_byte[by_byte > 0] / len(text)
    words = text.split()
    lines = text.split(b"\n")
    n_words = max(1, len(words))
    root = lambda x: float(np.sqrt(max(x, 0.0)))
    return [
        float(np.log1p(len(words))),
        float(np.log1p((chars - n[8] - n[9]) / n_words)),
        root(n[1] / max(1.0, n[0] + n[1] + n[2])),
        root(n[3] / chars),
        root(n[4] / n_words),
        root(n[5] / n_words),
        root(n[6] / n_words),
        root(n[7] / n_words),
        root(n[8] / n_words),
        root(n[9] / chars),
        root(n[0] / chars),
        float(-(share * np.log(share)).sum()),
        float(np.log1p(len(set(words))) / np.log1p(n_words)),
        root(sum(map(eq, words, words[1:])) / n_words),
        float(np.log1p(len(set(lines))) / np.log1p(len(lines))),
        float(np.log1p(max(map(len, words), default=0))),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(b) for b in blobs(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(x, pa.list_(pa.float64()))],
            names=["doc_id", "held_out", "x"],
        )


def measure(docs: DataFrame, held: int = 5) -> DataFrame:
    """(doc_id, held_out, x): statistics of every document; held_out marks the fold no label is learned from."""
    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), held) == 0).alias("held_out"), F.col("text"))
    return rows.mapInArrow(_measure, _SCHEMA)


@dataclass
class Discriminant:
    """Two Gaussians with cached Cholesky factors, and the line that turns their difference into a probability."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    log_norms: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, by Mahalanobis distances."""
        z = (x - self.centre) / self.scale
        density = []
        for mean, inverse, norm in zip(self.means, self.inverse_factors, self.log_norms):
            y = (z - mean) @ inverse.T
            density.append(-0.5 * (y * y).sum(axis=1) - norm)
        return np.clip(density[1] - density[0], -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: the number of rows, sums and sums of products."""
    d = len(FEATURES)
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
        label = batch.column("quality").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            mine = x[label == k]
            if len(mine):
                one = np.concatenate([np.ones((len(mine), 1)), mine], axis=1)
                sums[k] = sums.get(k, 0) + one.T @ one
    rows = [(k, i, float(v)) for k, m in sums.items() for i, v in enumerate(m.ravel())]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
        names=["quality", "cell", "value"],
    )


def fit_moments(moments: dict[int, np.ndarray], pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """Class covariances shrunk towards the pooled one and towards the unit matrix (in pooled deviations)."""
    n = np.array([moments[k][0, 0] for k in (0, 1)])
    mean = np.array([moments[k][0, 1:] / moments[k][0, 0] for k in (0, 1)])
    second = np.array([moments[k][1:, 1:] / moments[k][0, 0] for k in (0, 1)])
    centre = (n[:, None] * mean).sum(axis=0) / n.sum()
    spread = (n[:, None] * second.diagonal(axis1=1, axis2=2)).sum(axis=0) / n.sum() - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-8))
    cov = np.array([(s - np.outer(m, m)) / np.outer(scale, scale) for s, m in zip(second, mean)])
    both = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    inverse, norms = [], []
    for own, size in zip(cov, n):
        weight = max(pooled, min(1.0, 2 * len(centre) / size))  # few rows lean on the pooled matrix
        shrunk = (1 - ridge) * ((1 - weight) * own + weight * both) + ridge * np.eye(len(centre))
        factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(len(centre)))
        inverse.append(np.linalg.inv(factor))
        norms.append(np.log(factor.diagonal()).sum())
    return Discriminant(centre, scale, (mean - centre) / scale, np.array(inverse), np.array(norms))


def _calibrate(model: Discriminant, counts: list[tuple[int, int, int]]) -> None:
    """Logistic line over (cell, label, rows); a weak prior keeps it finite where the classes part cleanly."""
    t = np.array([c / GRID for c, _, _ in counts])
    y = np.array([float(k) for _, k, _ in counts])
    w = np.array([float(n) for _, _, n in counts])
    beta = np.array([0.1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta[0] * t + beta[1], -500, 500)))
        design = np.stack([t, np.ones_like(t)], axis=1)
        gradient = design.T @ (w * (y - p)) - np.array([1.0, 0.01]) * (beta - np.array([0.5, 0.0]))
        hessian = (design * (w * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ design + np.diag([1.0, 0.01])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -1, 1)
        if abs(step).max() < 1e-10:
            break
    model.slope, model.offset = max(float(beta[0]), 1e-6), float(beta[1])


def train(measured: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Learns from all labelled rows outside the held-out fold; None where a class has no rows.

    Only sums per class and counts per cell of the log-density difference reach the driver; their number is fixed
    by the number of statistics and by ``CLIP`` and ``GRID``.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("quality IN (0, 1)")
    known = stage(measured.filter("NOT held_out").join(marked, "doc_id").select("x", "quality"), "quality-known")
    sums = known.mapInArrow(_moments, "quality int, cell int, value double").groupBy("quality", "cell").agg(F.sum("value").alias("v"))
    d = len(FEATURES) + 1
    moments: dict[int, np.ndarray] = {}
    for k, cell, value in sums.collect():
        moments.setdefault(k, np.zeros(d * d))[cell] = value
    if set(moments) != {0, 1}:
        return None
    model = fit_moments({k: m.reshape(d, d) for k, m in moments.items()})

    def cells(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            cell = np.rint(model.difference(x) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("quality")], names=["cell", "quality"])

    counts = known.mapInArrow(cells, "cell int, quality int").groupBy("cell", "quality").count()
    _calibrate(model, sorted(tuple(r) for r in counts.collect()))
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of the documents.

    A null text is scored as an empty one; without labelled rows of both classes every score is 0.5. Rows of
    ``labels`` without a quality of 0 or 1 are not used; repeated rows count as often as they occur.
    """
    measured = stage(measure(docs, held), "quality-measured")
    model = train(measured, labels)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return measured.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held: int = 5) -> DataFrame:
    """The documents with a score of ``threshold`` at least, columns kept as they are.

    The model is small, so texts are scored where they are read: no join by id, no shuffle of texts.
    """
    model = train(stage(measure(docs, held), "quality-measured"), labels)
    if model is None:
        return docs.filter(F.lit(0.5 >= threshold))

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        x = np.array([statistics((t or "").encode()) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x) >= threshold)

    return docs.filter(accepted(docs["text"]))
