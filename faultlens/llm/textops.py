"""Vectorised token and code point work inside Arrow batches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2_000_000


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to ``limit`` at most; a larger row gets a range of its own."""
    start = total = n = 0
    for n, size in enumerate(sizes, 1):
        if total and total + size > limit:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def words(blob: bytes) -> list[bytes]:
    """Words between ASCII blanks, with A-Z lower-cased."""
    return blob.lower().split()


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the bounds of each text in them."""
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    ids, bounds = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        mine = list(map(index.__getitem__, words(text)))
        bounds[i + 1] = bounds[i] + len(mine)
        ids.append(np.array(mine, np.int64))
    table = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
    return (table[np.concatenate(ids)] if len(index) else np.empty(0, np.uint64)), bounds


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive values: position i covers i .. i+k-1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mix(out)
