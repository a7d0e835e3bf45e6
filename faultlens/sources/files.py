"""Readers and writers of case files, result files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.sources import schemas


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cases from a JSON array file; ``lines=True`` for one JSON object per line, which Spark can split."""
    return spark.read.schema(schemas.CASES).option("multiLine", not lines).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.RESULTS_CSV)
        .option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
        .csv(path)
    )


def results_as_csv_rows(results: DataFrame) -> DataFrame:
    """The fixed CSV columns, with the confidence at four digits (halves go to the even digit)."""
    confidence = F.format_string("%.4f", F.bround("confidence", 4)).alias("confidence")
    return results.select(*[confidence if c == "confidence" else F.col(c) for c in fv.RESULT_CSV_COLUMNS])


def write_results_csv(results: DataFrame, path: str) -> None:
    rows = results_as_csv_rows(results)
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).mode("errorifexists").csv(path)


def write_results_json(results: DataFrame, path: str) -> None:
    """One object per line with all fields; ``error`` is left out where empty."""
    results.withColumn("error", F.nullif(F.col("error"), F.lit(""))).write.mode("errorifexists").json(path)


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.RESULTS_CSV}, log_snippet string, error string").json(path)


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_version(table: DataFrame, base: str, version: int) -> str:
    """A new table state goes to its own folder, never over the files it was computed from."""
    path = f"{base.rstrip('/')}/version={version:06d}"
    table.write.mode("errorifexists").parquet(path)
    return path
