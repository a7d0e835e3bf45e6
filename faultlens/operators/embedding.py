"""Text to vector: a built-in hashed bag of words, and a hook for a real model."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import tokens

DIM = 64


def _word_hashes(words: pa.Array) -> np.ndarray:
    """The first three hex digits of each word's MD5 as one number; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    digests = (hashlib.md5(w.encode(), usedforsecurity=False).digest() for w in coded.dictionary.to_pylist())
    return np.fromiter((d[0] << 4 | d[1] >> 4 for d in digests), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]


def _unit_vectors(words: pa.Array) -> pa.Array:
    """The first digit (modulo 4) and the second name a counter, the third says whether the word counts up or down."""
    flat = _word_hashes(words.flatten())
    counter = (flat >> 8) % 4 * 16 + (flat >> 4) % 16
    at = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy()) * DIM + counter
    sums = np.bincount(at, weights=np.where(flat % 16 < 8, 1, -1), minlength=len(words) * DIM).reshape(-1, DIM)
    length = np.sqrt((sums * sums).sum(axis=1))
    some = length > 0
    units = (sums[some] / length[some, None]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * DIM)]), pa.int32()), pa.array(units.ravel()), mask=pa.array(~some))


def hashed_vector(text: Column) -> Column:
    """Words hashed into 64 signed counters, scaled to unit length; null without words, or where all cancel out.

    One vectorised function per Arrow batch hashes its distinct words, counts and scales. No shuffle.
    """
    return F.arrow_udf(_unit_vectors, "array<float>")(tokens(text))


def hashed_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, embedding), a row for each row; keys need not be unique."""
    return df.select(key, hashed_vector(F.col(text)).alias("embedding"))


hashed_vectors.column = hashed_vector  # where a text can be embedded without a join


def model_vectors(
    df: DataFrame,
    key: str,
    text: str,
    client_factory: Callable[[], Callable[[str], Sequence[float]]],
    waits: Sequence[float] = tuple(fv.RETRY_WAITS),
) -> DataFrame:
    """(key, embedding) from a model client, one client per task; rows that keep failing get null.

    Repartition ``df`` first to set how many clients run side by side.
    """
    key_type = df.schema[key].dataType.simpleString()

    def embed(batches):
        client = client_factory()
        for batch in batches:
            vectors = []
            for value in batch[text]:
                vectors.append(None)
                for wait in waits:
                    time.sleep(wait)
                    try:
                        vectors[-1] = [float(x) for x in client(value)]
                        break
                    except Exception:  # noqa: BLE001  a failing row must not end the job
                        continue
            yield pd.DataFrame({key: batch[key], "embedding": vectors})

    return df.select(key, text).mapInPandas(embed, f"`{key}` {key_type}, embedding array<float>")


def embed_report(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """success and failed counts over the rows that had no vector before."""
    todo = before.filter(F.col("embedding").isNull()).select(key)
    done = todo.join(after.select(key, "embedding"), key, "left")
    return done.agg(
        F.count_if(F.col("embedding").isNotNull()).alias("success"),
        F.count_if(F.col("embedding").isNull()).alias("failed"),
    )
