"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",  # the last of equal keys counts
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call-site lookup per column
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_FOLDERS: dict[str, str] = {}


def _own_folder() -> str:
    """A folder that goes when this process ends."""
    folder = tempfile.mkdtemp(prefix="faultlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def local_session(cores: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A session on this machine for tests and the bench; a cluster brings its own.

    Its work folder is a new one, unless ``spark.checkpoint.dir`` is given.
    """
    extra.setdefault("spark.checkpoint.dir", _own_folder())
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        # small local shuffles hold heavy rows: keep them spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(cores * 2))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder named in ``spark.checkpoint.dir``.

    Only where a session on a single machine leaves that setting out, a folder of our own is set for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _FOLDERS.get(spark.sparkContext.applicationId)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _FOLDERS[spark.sparkContext.applicationId] = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
