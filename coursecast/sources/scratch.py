"""Shared scratch folder for small tables that later steps read more than once."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a local folder only for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="coursecast-"))
        root = _local_root[0]
    return f"{root}/coursecast/{name}-{uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    The result has a known file size, so Spark broadcasts it in joins when it is below
    ``autoBroadcastJoinThreshold`` and uses a shuffle join with skew handling when it is not.
    It also survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
