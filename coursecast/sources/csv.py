"""CSV files to typed tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from csv import reader
from pathlib import PurePosixPath
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.functions.names import clean_columns, clean_name
from coursecast.functions.numbers import is_long_whole, is_number, is_whole
from coursecast.schema import CSV_NULLS
from coursecast.sources.replace import file_system, move, remove, replace_table

SHORT_TEXT = 255
LOADS_AT_ONCE = 8
DOUBLE_DIGITS = 15

SPARK_TYPES = {
    "INTEGER": "bigint",
    "NUMERIC": "double",
    "NUMERIC(38,0)": "decimal(38,0)",
    "TIMESTAMP": "timestamp",
    "VARCHAR(255)": "string",
    "TEXT": "string",
}


def read_text_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """All columns as text, cleaned names, missing-value words as null.

    Several files must have the same header. Files are split across tasks unless ``multiline`` allows line breaks inside quotes.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("enforceSchema", False)  # a file with other columns stops the job
        .csv(path)
    )
    raw = clean_columns(raw)
    return raw.select(
        [F.when(~F.col(c).isin(*CSV_NULLS), F.col(c)).alias(c) for c in raw.columns]
    )


def _text_kind(c: Column) -> Column:
    """The type of a column of text, as an aggregate over its values."""
    short = F.coalesce(F.max(F.length(c)), F.lit(0)) <= SHORT_TEXT
    # 3 for whole numbers in a bigint, 2 for longer ones, 1 for other numbers, 0 for text; the least decides.
    rank = F.when(is_whole(c), 3).when(is_long_whole(c), 2).when(is_number(c), 1).otherwise(0)
    least = F.min(F.when(c.isNotNull(), rank))
    exact = F.coalesce(F.max(F.when(is_long_whole(c), F.length(c))) > DOUBLE_DIGITS, F.lit(False))
    return (
        F.when((least == 3) & (F.count(c) == F.count(F.lit(1))), "INTEGER")
        .when((least >= 2) & exact, "NUMERIC(38,0)")
        .when((F.coalesce(least, F.lit(1)) >= 1) & ~exact, "NUMERIC")
        .when(short, "VARCHAR(255)")
        .otherwise("TEXT")
    )


def infer_types(df: DataFrame) -> DataFrame:
    """(ordinal, column, sql_type, max_length): one aggregation over all columns.

    A text column is INTEGER when every row holds a whole number that fits a bigint, NUMERIC when
    every value present is a number (or none is present), else VARCHAR(255) or TEXT by its longest
    value. Whole numbers that a double cannot tell apart are NUMERIC(38,0), or text among fractions.
    """
    return _measured(df).drop("n_rows")


def _measured(df: DataFrame) -> DataFrame:
    """The types with ``n_rows``, the number of rows."""
    measures = []
    for field in df.schema.fields:
        c = F.col(field.name)
        length = F.max(F.length(c.cast("string")))
        if isinstance(field.dataType, T.StringType):
            kind = _text_kind(c)
        elif isinstance(field.dataType, T.IntegralType):
            kind = F.lit("INTEGER")
        elif isinstance(field.dataType, T.NumericType):
            kind = F.lit("NUMERIC")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            kind = F.lit("TIMESTAMP")
        else:
            kind = F.when(length <= SHORT_TEXT, "VARCHAR(255)").otherwise("TEXT")
        measures.append((field.name, kind, length))
    one_row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("ordinal"),
                    F.lit(name).alias("column"),
                    kind.alias("sql_type"),
                    length.cast("bigint").alias("max_length"),
                )
                for i, (name, kind, length) in enumerate(measures, start=1)
            ]
        ).alias("columns"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return one_row.select(F.inline("columns"), "n_rows")


def load_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A CSV file (or several of one shape) as a typed table.

    With ``schema`` the file is read once; without it one extra pass infers the types.
    A file without rows is an error.
    """
    text = read_text_csv(spark, path, multiline)
    if schema is not None:
        if text.isEmpty():
            raise ValueError(f"CSV file is empty: {path}")
        types = {clean_name(f.name): f.dataType for f in schema.fields}
        missing = sorted(set(types) - set(text.columns))
        if missing:
            raise ValueError(f"columns missing from {path}: {missing}")
    else:
        found = _measured(text).collect() if text.columns else []
        if not found or not found[0]["n_rows"]:
            raise ValueError(f"CSV file is empty: {path}")
        types = {r["column"]: SPARK_TYPES[r["sql_type"]] for r in found}
    return text.select([F.col(c).try_cast(types.get(c, "string")).alias(c) for c in text.columns])


def save_table(df: DataFrame, target: str, partition_by: str | None = "term") -> None:
    """Replace a table, stored by term where it has one so that term filters prune files.

    ``target`` is a path when it has a slash, else a catalog table name. Rows are brought together
    by term first, so that each reading task does not leave a small file in every term. The
    rebalance splits a term that holds most of the data over many tasks. The new table is written beside
    the old one and takes its place at the end, so that a load that fails changes nothing.
    """
    keys = [partition_by] if partition_by in df.columns and len(df.columns) > 1 else []
    replace_table(df.hint("rebalance", *keys) if keys else df, target, keys)


def sample_rows(df: DataFrame, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """A few rows: any, or the first ``by`` some columns."""
    return df.orderBy(*by).limit(n) if by else df.limit(n)


def csv_paths(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder on any file system Spark can read, by name; empty ones as well."""
    files, place = file_system(spark, f"{folder.rstrip('/')}/*.csv")
    return sorted(f.getPath().toString() for f in files.globStatus(place) or [])


def table_name(path: str) -> str:
    return clean_name(PurePosixPath(path).stem)


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The first line of each file by path, in one job; a file without a line is left out."""
    if not paths:
        return {}
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return {unquote(r["file"]): r["header"].removeprefix("\ufeff").rstrip("\r") for r in first.collect()}


def header_names(header: str) -> list[str]:
    """Cleaned column names of a header line."""
    return [clean_name(c) for c in next(reader([header]), [])]


def read_positional(spark: SparkSession, paths: Sequence[str], width: int, multiline: bool = False) -> DataFrame:
    """Files of any header in one scan: ``file`` and ``cells``, the first ``width`` values of a row as text and one more,
    which is null unless the row is too long. Missing-value words are null."""
    names = [f"c{i}" for i in range(width + 1)]
    raw = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        .option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .csv(list(paths))
    )
    cells = F.array(*[F.when(~F.col(n).isin(*CSV_NULLS), F.col(n)) for n in names])
    return raw.select(F.col("_metadata.file_path").alias("file"), cells.alias("cells"))


def by_file(values: dict[str, object], kind: str) -> Column:
    """A value for each row's ``file``; the map is a literal of one entry per file."""
    packed = F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")
    return packed[F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))]


def load_csv_dir(spark: SparkSession, folder: str, out: str, multiline: bool = False) -> DataFrame:
    """Load every ``*.csv`` of a folder as one table each under ``out``.

    Returns (table_name, loaded, error), a row per file; one file that fails does not stop the others. Of files whose names
    give the same table the first is loaded, the others are errors. All files are read together, whatever their number: one
    job takes the headers, one the types of all columns from (file, column, value) rows, and one write serves all
    files of the same columns and types. Each table then takes the place of its old version.
    """
    paths = csv_paths(spark, folder)
    owner: dict[str, str] = {}
    errors: dict[str, str] = {}
    for path in paths:
        first = owner.setdefault(table_name(path), path)
        if first != path:
            errors[path] = f"the table {table_name(path)} is that of {PurePosixPath(first).name}"
    names = {p: header_names(h) for p, h in headers(spark, [p for p in paths if p not in errors]).items()}
    for path in paths:
        if path in errors:
            continue
        if not names.get(path) or names[path] == [""]:
            errors[path] = f"CSV file is empty: {path}"
        elif len(set(names[path])) < len(names[path]) or "" in names[path]:
            errors[path] = f"columns without a name of their own: {names[path]}"
    good = [p for p in paths if p not in errors]
    kinds: dict[str, dict[int, str]] = {}
    if good:
        width = max(len(names[p]) for p in good)
        cells = read_positional(spark, good, width, multiline)
        own = by_file({p: len(names[p]) for p in good}, "int")
        # A row's own columns, and the first beyond them that has a value.
        numbered = F.transform("cells", lambda v, i: F.struct(i.alias("at"), v.alias("value")))
        cell = F.explode(F.filter(numbered, lambda x: (x["at"] < F.col("width")) | x["value"].isNotNull())).alias("cell")
        narrow = cells.withColumn("width", own).select("file", cell).select("file", "cell.at", "cell.value")
        for r in narrow.groupBy("file", "at").agg(_text_kind(F.col("value")).alias("kind")).collect():
            kinds.setdefault(unquote(r["file"]), {})[r["at"]] = r["kind"]
    shapes: dict[tuple, list[str]] = {}
    for path in good:
        found = kinds.get(path)
        if not found:
            errors[path] = f"CSV file is empty: {path}"
        elif max(found) >= len(names[path]):
            errors[path] = f"a row has more values than the header has columns: {path}"
        else:
            shapes.setdefault((tuple(names[path]), tuple(found[i] for i in range(len(names[path])))), []).append(path)

    def store(shape: tuple[tuple, list[str]]) -> None:
        (columns, types), files = shape
        try:
            rows = read_positional(spark, files, len(columns), multiline)
            table = fresh_name(columns, "table_name")
            typed = rows.select(
                by_file({p: table_name(p) for p in files}, "string").alias(table),
                *[F.get("cells", i).try_cast(SPARK_TYPES[t]).alias(c) for i, (c, t) in enumerate(zip(columns, types))],
            )
            keys = [table, *(["term"] if "term" in columns and len(columns) > 1 else [])]
            staged = f"{out.rstrip('/')}/.load-{uuid4().hex}"
            try:
                typed.hint("rebalance", *keys).write.partitionBy(*keys).parquet(staged)
                for p in files:
                    move(spark, f"{staged}/{table}={table_name(p)}", f"{out.rstrip('/')}/{table_name(p)}")
            finally:
                remove(spark, staged)
        except Exception as error:  # reported in the result rows
            errors.update(dict.fromkeys(files, str(error)))

    with ThreadPoolExecutor(LOADS_AT_ONCE) as pool:
        list(pool.map(store, shapes.items()))
    outcome = [Row(table_name=table_name(p), loaded=p not in errors, error=errors.get(p)) for p in paths]
    return spark.createDataFrame(outcome, "table_name string, loaded boolean, error string")


def fresh_name(taken: Sequence[str], base: str) -> str:
    while base in taken:
        base += "_"
    return base
