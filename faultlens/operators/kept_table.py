"""The knowledge table in buckets of ids: a change writes the buckets it touches, all other files stay as they are.

``data/version=…/bucket=…`` hold rows, ``manifest/version=…`` the pairs of version and bucket that are the table as of that version. A
version counts once its manifest is written; one that broke off before is written over. There is one writer at a time.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultlens.operators import knowledge as kn
from faultlens.operators.embedding import hashed_vectors
from faultlens.sources import schemas
from faultlens.sources.stage import stage

BUCKETS = 64
_EMPTY = (-1, -1)  # in every manifest: a version without rows is a version too


@dataclass(frozen=True)
class BucketedTable:
    spark: SparkSession
    base: str
    buckets: int = BUCKETS

    def _bucket(self, key: str = "id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("data_version int, data_bucket int, version int").parquet(f"{self.base}/manifest")

    def version(self) -> int:
        return self._manifests().agg(F.max("version").alias("v")).first()["v"]

    def _parts(self, version: int) -> list[tuple[int, int]]:
        rows = self._manifests().filter(F.col("version") == version).select("data_version", "data_bucket").distinct().collect()
        return sorted({(r["data_version"], r["data_bucket"]) for r in rows} - {_EMPTY})  # a few per bucket

    def read(self, buckets: set[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its buckets; now, or as of an earlier version. Other folders are not read."""
        wanted = defaultdict(list)
        for v, b in self._parts(self.version() if version is None else version):
            if buckets is None or b in buckets:
                wanted[v].append(b)
        data = self.spark.read.schema(f"{schemas.KNOWLEDGE}, version int, bucket int").parquet(f"{self.base}/data")
        in_version = [(F.col("version") == v) & F.col("bucket").isin(bs) for v, bs in wanted.items()]
        return data.filter(reduce(Column.__or__, in_version, F.lit(False))).drop("version", "bucket")

    def create(self, rows: DataFrame) -> None:
        self._write(rows, 0, [])

    def _write(self, rows: DataFrame, version: int, kept: list[tuple[int, int]]) -> None:
        """A version of the kept parts and of new ones with these rows."""
        path = f"{self.base}/data/version={version}"
        dealt = rows.select(*kn.FIELDS, self._bucket().alias("bucket")).repartition("bucket", F.pmod(F.xxhash64("id", "title"), F.lit(4)))
        dealt.sortWithinPartitions("bucket", "id").write.partitionBy("bucket").mode("overwrite").parquet(path)
        written = self.spark.read.schema(f"{schemas.KNOWLEDGE}, bucket int").parquet(path).select("bucket").distinct().collect()
        pairs = [_EMPTY, *kept, *((version, r["bucket"]) for r in written)]
        manifest = self.spark.createDataFrame(pairs, "data_version int, data_bucket int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/version={version}")

    def _touched(self, ids: DataFrame) -> set[int]:
        return {r["b"] for r in ids.select(self._bucket().alias("b")).distinct().collect()}  # at most all buckets

    def _replace(self, touched: set[int], change) -> None:
        version = self.version()
        if touched:
            kept = [(v, b) for v, b in self._parts(version) if b not in touched]
            self._write(change(self.read(touched)), version + 1, kept)

    def update(self, changes: DataFrame, embed=hashed_vectors, now: Column | None = None) -> DataFrame:
        """``kb_update`` of the buckets that hold a changed id; returns the changes of unknown ids, which change nothing."""
        changes = stage(changes, "table-changes")
        before = self.read(self._touched(changes))
        rejected = stage(kn.kb_update_rejects(before, changes), "table-rejects")
        known = stage(changes.join(before.select("id"), "id", "left_semi"), "table-known")
        self._replace(self._touched(known), lambda part: kn.kb_update(part, known, embed, now))
        return rejected

    def delete(self, ids: DataFrame) -> None:
        ids = stage(ids.select("id"), "table-deletes")
        known = self.read(self._touched(ids)).join(ids, "id", "left_semi").select("id")
        self._replace(self._touched(known), lambda part: kn.kb_delete(part, ids))

    def backfill(self, embed=hashed_vectors) -> None:
        self._replace(self._touched(kn.kb_missing_embedding(self.read())), lambda part: kn.kb_backfill(part, embed))

    def insert(self, rows: DataFrame, embed=hashed_vectors, now: Column | None = None) -> None:
        """New rows under new ids are a part of their own in each bucket: no file that is there is written again."""
        version = self.version()
        last = self.read().select("id")
        whole = kn.new_rows(last, rows, embed, now)
        self._write(whole, version + 1, self._parts(version))

    def compact(self) -> None:
        """All buckets as one part each, in a new version."""
        self._write(self.read(), self.version() + 1, [])
