"""Load CSV files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from coursecast.functions.names import clean_name
from coursecast.schema import CSV_NULLS
from coursecast.sources.csv import header_names, headers, read_positional


def read_drop_folder(
    spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 1000
) -> DataFrame:
    """A stream over the ``*.csv`` files of a folder.

    ``schema`` has the names of the files' header line, in order; a file with another header
    stops the stream. Column names are cleaned and bad cells become null.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.readStream.schema(texts)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("pathGlobFilter", "*.csv")
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
    )
    return raw.select(
        [
            F.when(~F.col(f"`{f.name}`").isin(*CSV_NULLS), F.col(f"`{f.name}`"))
            .try_cast(f.dataType)
            .alias(clean_name(f.name))
            for f in schema.fields
        ]
    )


def load_new_files(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    schema: T.StructType,
    partition_by: str | None = "term",
    timeout: int | None = None,
) -> StreamingQuery:
    """Append the files not loaded before to a parquet table and stop.

    The file source remembers each file it has read. A batch is stored under ``batch=<number>``, which a
    repeated batch replaces, so a file is loaded once even when a run is cut off and started again. Rows are
    brought together by ``partition_by`` first: a few files per value and batch, not one per task.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.hint("rebalance", partition_by) if partition_by else batch
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{out}/batch={number}")

    query = (
        read_drop_folder(spark, folder, schema)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(timeout)
    return query


def load_mixed_files(
    spark: SparkSession, folder: str, out: str, checkpoint: str, shapes: Mapping[str, T.StructType], max_files: int = 1000,
    timeout: int | None = None,
) -> StreamingQuery:
    """Append the files not loaded before to the tables that their headers name, and stop.

    A file belongs to the table of ``shapes`` whose (cleaned) columns its header has, in any order. Each table's rows of a
    batch go to ``out/<table>/batch=<number>``; the files of one header order are read in one scan. Files that fit no table,
    or have a row longer than their header, are rows of ``out/rejected`` (file, header, reason), and the stream goes on. Bad cells
    become null. A batch that is repeated replaces what it had written.
    """
    wanted = {frozenset(clean_name(f.name) for f in kind.fields): name for name, kind in shapes.items()}
    types = {name: {clean_name(f.name): f.dataType for f in kind.fields} for name, kind in shapes.items()}
    listing = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(listing).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", max_files)
        .load(folder).select("path")
    )

    def store(batch: DataFrame, number: int) -> None:
        paths = sorted(unquote(r.path) for r in batch.collect())  # at most max_files
        found = headers(spark, paths)
        rejected, groups = [], {}
        for path in paths:
            names = header_names(found.get(path, ""))
            table = wanted.get(frozenset(names)) if len(set(names)) == len(names) else None
            if table is None:
                rejected.append((path, found.get(path), "no table has these columns"))
            else:
                groups.setdefault((table, tuple(names)), []).append(path)
        parts: dict[str, list[DataFrame]] = {}
        for (table, names), mine in groups.items():
            rows = read_positional(spark, mine, len(names))
            too_long = {unquote(r.file) for r in rows.filter(F.get("cells", len(names)).isNotNull()).select("file").distinct().collect()}
            rejected += [(p, found[p], "a row has more values than the header has columns") for p in sorted(too_long)]
            if good := [p for p in mine if p not in too_long]:
                rows = read_positional(spark, good, len(names))
                cells = [F.get("cells", names.index(c)).try_cast(kind).alias(c) for c, kind in types[table].items()]
                parts.setdefault(table, []).append(rows.select(cells))
        for table, frames in parts.items():
            reduce(DataFrame.unionByName, frames).hint("rebalance").write.mode("overwrite").parquet(f"{out}/{table}/batch={number}")
        if rejected:
            odd = spark.createDataFrame(rejected, "file string, header string, reason string")
            odd.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    query = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    return query
