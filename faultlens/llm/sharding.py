"""Sharding by a lookup table that the shards fill in turns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.tables import hash32

SLOTS = 65537
MAX_SLOTS = 2_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Shard number of each slot.

    Each shard prefers the slots in the order offset, offset + skip, ... (modulo the prime number of slots, so
    that it reaches all of them). The shards take turns; at its turn a shard claims the first slot of its own
    order that is still free. Equal turns give shares that differ by one slot at most, and a shard that goes
    away frees few slots of others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    offset = [xxhash.xxh64_intdigest(s, seed=1) % slots for s in shards]
    skip = [xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    owner, at, left = [-1] * slots, list(offset), slots
    while left:
        for shard in range(min(len(shards), left)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + skip[shard]) % slots
            owner[slot], at[shard] = shard, (slot + skip[shard]) % slots
            left -= 1
    return np.array(owner, np.int32)


def assign_shards(docs: DataFrame, shards: Sequence[str], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """Adds slot (long) and shard (int) to the rows, by the key alone.

    The table has a fixed number of slots (``MAX_SLOTS`` at most), whatever the number of rows, so it is broadcast and
    each row is placed by one lookup without a shuffle. Rows with equal keys, and all rows with a null key, go
    to the same shard; all other columns are kept, and columns named slot or shard are replaced.
    """
    spark = docs.sparkSession
    owners = fill_table(shards, slots)
    lookup = spark.createDataFrame([(i, int(s)) for i, s in enumerate(owners)], "_slot long, _shard int")
    kept = docs.select([docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("slot", "shard")])
    placed = kept.withColumn("_slot", F.pmod(hash32(F.col(f"`{key}`")), F.lit(slots)))
    joined = placed.join(F.broadcast(lookup), "_slot")
    return joined.withColumnsRenamed({"_slot": "slot", "_shard": "shard"}).select(*[f"`{c}`" for c in kept.columns], "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], slots: int = SLOTS, key: str = "doc_id", parts: int = 16) -> None:
    """Writes the rows in one folder per shard (shard=0, 1, ...), each dealt to up to ``parts`` files."""
    placed = assign_shards(docs, shards, slots, key)
    spread = placed.repartition("shard", F.pmod(F.col("slot"), F.lit(parts)))
    spread.drop("slot").write.partitionBy("shard").parquet(path)
