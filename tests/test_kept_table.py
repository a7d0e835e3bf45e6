"""The bucketed table: changes give the same rows as on whole tables and touch only their buckets."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from faultlens.operators import knowledge as kn
from faultlens.operators.kept_table import BucketedTable
from faultlens.sources import schemas

T0 = dt.datetime(2024, 1, 1)
TEXTS = "id long, title string, content string, category string, keywords string, symptoms string"


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def rows_of(df):
    return sorted(map(str, df.select(*kn.FIELDS).collect()))


def files(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in folder.rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"t{i}", f"c{i}", "cat", "k", "s", None if i % 4 == 0 else [float(i)], T0, T0) for i in range(1, 61)]
    whole = spark.createDataFrame(rows, schemas.KNOWLEDGE)
    kept = BucketedTable(spark, str(tmp_path / "kb"), 8)
    kept.create(whole)
    return kept, whole, tmp_path / "kb"


def test_changes_equal_those_of_whole_tables(spark, table):
    kept, whole, _ = table
    assert rows_of(kept.read()) == rows_of(whole)
    changes = spark.createDataFrame([(i, "new", f"n{i}", "c", "", "") for i in (3, 4, 5, 900)], TEXTS)
    assert [r.id for r in kept.update(changes, now=now()).collect()] == [900]
    whole = kn.kb_update(whole, changes, now=now())
    assert rows_of(kept.read()) == rows_of(whole)
    gone = spark.createDataFrame([(i,) for i in (4, 7, 901)], "id long")
    kept.delete(gone)
    whole = kn.kb_delete(whole, gone)
    assert rows_of(kept.read()) == rows_of(whole)
    fresh = changes.drop("id").withColumn("title", F.concat(F.lit("x"), "content"))
    kept.insert(fresh, now=now())
    whole = kn.kb_insert(whole, fresh, now=now())
    assert rows_of(kept.read()) == rows_of(whole)
    kept.backfill()
    whole = kn.kb_backfill(whole)
    assert rows_of(kept.read()) == rows_of(whole) and kept.read().filter("embedding IS NULL").count() == 0
    kept.compact()
    assert rows_of(kept.read()) == rows_of(whole)
    assert kept.version() == 5 and kept.read(version=0).count() == 60


def test_a_change_leaves_other_buckets_alone(spark, table):
    kept, _, folder = table
    before = files(folder / "data")
    kept.update(spark.createDataFrame([(3, "new", "n", "c", "", "")], TEXTS), now=now())
    after = files(folder / "data")
    assert {p: after[p] for p in before} == before
    new = {p.split("bucket=")[1].split("/")[0] for p in set(after) - set(before)}
    bucket = spark.range(3, 4).select(kept._bucket().alias("b")).first().b
    assert new == {str(bucket)}
    kept.delete(spark.createDataFrame([(3,)], "id long"))
    assert {p: files(folder / "data")[p] for p in before} == before
    plan = kept.read({bucket})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan


def test_unknown_ids_write_nothing_and_broken_versions_do_not_count(spark, table):
    kept, whole, folder = table
    kept.update(spark.createDataFrame([(900, "new", "n", "c", "", "")], TEXTS))
    kept.delete(spark.createDataFrame([(901,)], "id long"))
    assert kept.version() == 0
    whole.limit(1).select(*kn.FIELDS, kept._bucket().alias("bucket")).write.partitionBy("bucket").parquet(str(folder / "data" / "version=1"))
    assert rows_of(kept.read()) == rows_of(whole)  # written, but no manifest
    kept.delete(spark.createDataFrame([(1,)], "id long"))
    assert kept.version() == 1 and kept.read().count() == 59


def test_a_bucket_that_empties(spark, tmp_path):
    kept = BucketedTable(spark, str(tmp_path / "kb"), 2)
    kept.create(spark.createDataFrame([(1, "t", "c", "", "", "", None, T0, T0)], schemas.KNOWLEDGE))
    kept.delete(spark.createDataFrame([(1,)], "id long"))
    assert kept.read().count() == 0
    kept.insert(spark.createDataFrame([("t", "c", "", "", "")], TEXTS.replace("id long, ", "")), now=now())
    assert [r.title for r in kept.read().collect()] == ["t"]
