"""What tables exist, what their columns mean, and queries over them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursecast.functions.names import role_flags
from coursecast.sources.replace import file_system

Tables = Mapping[str, DataFrame]


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The stored tables of a database by name, as lazy frames."""
    prefix = f"{database}." if database else ""
    return {
        t.name: spark.table(f"{prefix}{t.name}")
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
    }


def table_columns(spark: SparkSession, tables: Tables) -> DataFrame:
    """(table_name, ordinal, column_name) from the schemas; reads no data."""
    rows = [
        (name, i, column)
        for name in sorted(tables)
        for i, column in enumerate(tables[name].columns, start=1)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string")


def table_schema(tables: Tables) -> dict[str, dict[str, str]]:
    """The catalog in feature-schema form: ``{table: {column: ""}}``."""
    return {name: dict.fromkeys(tables[name].columns, "") for name in sorted(tables)}


def schema_rows(spark: SparkSession, tables: Tables) -> DataFrame:
    """(table_name, ordinal, column_name, description): the generated feature schema as a dataset, descriptions empty."""
    return table_columns(spark, tables).withColumn("description", F.lit(""))


def first_table_with(tables: Tables, columns: Iterable[str]) -> str | None:
    """First table, by name, that has all the columns."""
    needed = set(columns)
    return next((name for name in sorted(tables) if needed <= set(tables[name].columns)), None)


def row_counts(tables: Tables) -> DataFrame:
    """(table_name, row_count). Stored parquet tables are counted from their footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts)


def counted_files(df: DataFrame, kept: str) -> DataFrame:
    """(file, n_rows) of a stored table's files, from the counts kept at ``kept``.

    Only files that have no count yet are counted, from their footers, and added to it; files that are gone are left
    out. Files of tables are never changed, so a name stands for a content.
    """
    spark = df.sparkSession
    files, place = file_system(spark, kept)
    now = df.inputFiles()
    known = {r.file for r in spark.read.parquet(kept).select("file").collect()} if files.exists(place) else set()
    new = sorted(set(now) - known)
    if new:
        same = lambda c: F.regexp_replace(c, ":/+", ":/")  # noqa: E731  one form of a path without a host
        counts = spark.read.parquet(*map(unquote, new)).groupBy(same(F.col("_metadata.file_path")).alias("place")).agg(F.count(F.lit(1)).alias("n_rows"))
        listed = spark.createDataFrame([(f,) for f in new], "file string").withColumn("place", same(F.col("file")))
        listed.join(counts, "place", "left").select("file", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows")).coalesce(1).write.mode("append").parquet(kept)
    if not now:
        return spark.createDataFrame([], "file string, n_rows long")
    return spark.read.parquet(kept).join(F.broadcast(spark.createDataFrame([(f,) for f in now], "file string")), "file").select("file", "n_rows")


def table_roles(tables: Tables) -> DataFrame:
    """(table_name, has_subj .. has_enrollment, row_count) of every table."""
    flags = {name: role_flags(df.columns) for name, df in tables.items()}
    roles = list(next(iter(flags.values())))
    known = {role: [name for name, f in flags.items() if f[role]] for role in roles}
    return row_counts(tables).select(
        "table_name",
        *[F.col("table_name").isin(known[role]).alias(role) for role in roles],
        "row_count",
    )


def primary_candidates(roles: DataFrame) -> DataFrame:
    """Tables that can be the section table, with their score."""
    flags = [F.col(c) for c in roles.columns if c.startswith("has_") and c != "has_term"]
    points = sum((f.cast("int") * 10 for f in flags), F.lit(0))
    size = F.least(F.col("row_count") / 1000, F.lit(10.0))
    return roles.filter("has_subj and has_crse and has_semester and has_enrollment").select(
        "table_name", (points + size).alias("score")
    )


def primary_table(roles: DataFrame) -> DataFrame:
    """The best candidate: highest score, then first name. No row when none fits."""
    return primary_candidates(roles).orderBy(F.desc("score"), "table_name").limit(1)


def joinable_tables(roles: DataFrame, primary: str) -> DataFrame:
    """Other tables with a time column, and which of term/year/semester they offer."""
    return roles.filter(
        (F.col("table_name") != primary) & (F.col("has_term") | F.col("has_year") | F.col("has_semester"))
    ).select("table_name", "has_term", "has_year", "has_semester")


def run_query(
    spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **tables: DataFrame
) -> DataFrame:
    """Run a user's SELECT. Values go in ``args``, tables as ``{name}`` or catalog names.

    The text is placed in a subquery, so a statement that is not a query does not parse.
    """
    return spark.sql(f"select * from (\n{sql.strip().rstrip(';')}\n)", args=dict(args or {}), **tables)
