"""Prediction files and accuracy tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursecast.functions.courses import students
from coursecast.schema import ACCURACY_SCHEMA, PREDICTION_SCHEMA, REPORT_NAMES


def write_accuracy(accuracy: DataFrame, path: str) -> None:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in ACCURACY_SCHEMA.fields]
    accuracy.select(columns).write.mode("overwrite").option("header", True).csv(path)


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of one or several layouts as text columns, matched by name; absent ones are null.

    Each file's header is its first line. Files are grouped by it, so there is one read per layout.
    """
    first = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                                                     F.col("_metadata.file_block_start").alias("block"))
    first = first.filter("block = 0").groupBy("file").agg(F.first("value").alias("header"))
    layouts = first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()  # names of files only
    if not layouts:
        return spark.read.option("header", True).csv(path)
    frames = [
        spark.read.option("header", True).option("enforceSchema", False).csv(sorted(r.files))
        for r in sorted(layouts, key=lambda r: r.header)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """Accuracy tables; columns are matched by name, whatever their order in each file."""
    raw = _by_header(spark, path)
    missing = [f.name for f in ACCURACY_SCHEMA.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return raw.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in ACCURACY_SCHEMA.fields])


def read_predictions_json(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Predictions as JSON lines, or as one JSON array per file with ``one_array``.

    Fields beyond the fixed ones are kept as Spark infers them.
    """
    found = spark.read.option("multiLine", one_array).json(path)
    fixed = {f.name: f.dataType for f in PREDICTION_SCHEMA.fields}
    columns = [
        (F.col(n).try_cast(kind) if n in found.columns else F.lit(None).cast(kind)).alias(n) for n, kind in fixed.items()
    ]
    return found.select(*columns, *[F.col(f"`{c}`") for c in found.columns if c not in fixed])


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions in report or data column names; files may differ in columns and their order."""
    raw = _by_header(spark, path)
    types = {f.name: f.dataType for f in PREDICTION_SCHEMA.fields}
    columns = []
    for name, report in REPORT_NAMES.items():
        there = [F.col(c) for c in (name, report) if c in raw.columns]
        if there:
            columns.append(F.coalesce(*there).try_cast(types.get(name, "string")).alias(name))
    known = {*REPORT_NAMES, *REPORT_NAMES.values()}
    rest = [F.col(c).try_cast(types.get(c, "string")).alias(c) for c in raw.columns if c not in known]
    return raw.select(*columns, *rest)


def report_predictions(df: DataFrame) -> DataFrame:
    """Report column names, predictions as whole students."""
    if "prediction" in df.columns:
        df = df.withColumn("prediction", students(F.col("prediction")))
    return df.withColumnsRenamed({k: v for k, v in REPORT_NAMES.items() if k in df.columns})


def write_predictions_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
