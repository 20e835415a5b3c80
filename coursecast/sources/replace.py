"""Replacing a stored table: written beside it, switched at the end, so that a load that fails leaves the old one."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from coursecast.sources.scratch import scratch_path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def move(spark: SparkSession, written: str, target: str) -> None:
    """Put the folder ``written`` in the place of ``target``; the old one goes last, and comes back if the move fails."""
    files, new = file_system(spark, written)
    _, place = file_system(spark, target)
    _, aside = file_system(spark, f"{target.rstrip('/')}.old-{uuid4().hex}")
    files.mkdirs(place.getParent())
    had_one = files.exists(place)
    if had_one and not files.rename(place, aside):
        raise OSError(f"cannot move {target} aside")
    if not files.rename(new, place):
        if had_one:
            files.rename(aside, place)
        raise OSError(f"cannot put a new version at {target}")
    if had_one:
        files.delete(aside, True)


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)


def replace_table(rows: DataFrame, target: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``rows`` and switch ``target``, a path if it has a slash, else a catalog table's name, to them.

    A path is switched by renaming folders. A catalog table is overwritten by a copy of the rows once all of them are
    written, so that what can fail in making them fails before the table is touched.
    """
    spark = rows.sparkSession
    by_name = "/" not in target
    staged = scratch_path(spark, "table") if by_name else f"{target.rstrip('/')}.new-{uuid4().hex}"
    try:
        if by_name:
            rows.write.parquet(staged)
            made = spark.read.schema(rows.schema).parquet(staged)
            made.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).saveAsTable(target)
        else:
            rows.write.partitionBy(*partition_by).parquet(staged)
            move(spark, staged, target)
    finally:
        remove(spark, staged)
