"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}

# For a cluster: many small shuffle partitions to start with, which adaptive execution merges up to
# the advisory size (or splits, when one is skewed), and scan tasks that fit executor memory.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def session(name: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution on; ``extra`` keys use ``__`` for the dots.

    Without a ``master``, or with one that is not local, it also gets the cluster settings.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    local = master is not None and master.startswith("local")
    chosen = {k.replace("__", "."): v for k, v in extra.items()}
    for key, value in {**SETTINGS, **({} if local else CLUSTER_SETTINGS), **chosen}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
