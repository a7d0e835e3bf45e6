"""Intermediate tables in the shared work folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from faultlens.session import work_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and returns it as a table.

    Used where several later branches read the same costly columns, and where a step must not run twice (model
    calls). Lost executors re-read files instead of repeating the work.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
