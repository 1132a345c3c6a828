"""Shared storage for intermediate tables and the files that queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may leave it unset; then it is a new temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quartzite-"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "") -> DataFrame:
    """A reliable checkpoint: it survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
