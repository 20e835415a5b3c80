"""Data profiles: missing values, cardinality, target distribution, years, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.functions.terms import term_year, whole_term
from coursecast.operators.order import exact_quantiles
from coursecast.schema import TARGET
from coursecast.sources.replace import file_system
from coursecast.sources.scratch import settle

ID_WORDS = ("id", "guid", "uuid")  # fixed values: parts of a name that mark an id column


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct) of some columns.

    Narrow rows of a column's number and a value are made distinct, so that no row carries slots for the
    other columns, and equal values are merged before the shuffle.
    """
    cells = [F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    narrow = df.select(F.inline(F.array(*cells))).filter("value is not null").distinct()
    counts = narrow.groupBy("place").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(names[F.col("place")].alias("column_name"), "n_distinct")


def _with_distinct(stats: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column joined with its distinct count, 0 where all values are missing."""
    counts = _distinct_counts(df, columns)
    return stats.join(counts, "column_name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint")))


def feature_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, n_null, pct_null, n_distinct): a pass for nulls and one for distinct values."""
    rows = F.count(F.lit(1))
    cells = []
    for field in df.schema.fields:
        missing = F.count_if(F.col(field.name).isNull())
        cells.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                missing.alias("n_null"),
                F.try_divide(missing * 100.0, rows).alias("pct_null"),
            )
        )
    stats = df.agg(F.array(*cells).alias("columns")).select(F.inline("columns"))
    return _with_distinct(stats, df, df.columns)


def sample_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """A few distinct values of a column."""
    return df.select(column).distinct().limit(n)


def describe_target(df: DataFrame, column: str = TARGET) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column as one row.

    The column is written once; all figures come from that table.
    """
    stored = settle(df.select(column), "target")
    quartiles = exact_quantiles(stored, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    value = F.col(column)
    return stored.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("least"),
        *[F.lit(q).cast("double").alias(name) for name, q in quartiles.items()],
        F.max(value).alias("most"),
    )


def year_distribution(df: DataFrame, floor_year: int = 2023) -> DataFrame:
    """(year, n_rows, below_floor) in year order."""
    names = {c.lower(): c for c in df.columns}
    if "year" in names:
        year = F.col(names["year"]).cast("int")
    else:
        year = term_year(whole_term(df, names["term"]))
    return (
        df.groupBy(year.alias("year"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("year is not null")
        .withColumn("below_floor", F.col("year") < floor_year)
        .orderBy("year")
    )


def title_distribution(df: DataFrame) -> DataFrame:
    """Rows and enrollment statistics of each title, most frequent first."""
    return (
        df.filter("title is not null")
        .groupBy("title")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg("act").alias("mean_act"),
            F.min("act").alias("min_act"),
            F.max("act").alias("max_act"),
            F.count("act").alias("n_act"),
        )
        .orderBy(F.desc("n_rows"), "title")
    )


def text_cardinality(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, n_distinct, most_allowed, kept) of text columns.

    A text column is a usable category up to 100 values and up to a tenth of the rows.
    """
    texts = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]
    if not texts:
        empty = "column_name string, n_distinct bigint, most_allowed double, kept boolean"
        return df.sparkSession.createDataFrame([], empty)
    allowed = F.least(F.lit(100.0), F.count(F.lit(1)) * 0.1).alias("most_allowed")
    stats = df.agg(allowed).select(F.explode(F.array(*[F.lit(c) for c in texts])).alias("column_name"), "most_allowed")
    found = _with_distinct(stats, df, texts).select("column_name", "n_distinct", "most_allowed")
    return found.withColumn("kept", F.col("n_distinct") <= F.col("most_allowed"))


SKETCH_BITS = 14  # of a sketch's buckets: a standard error of about 0.6 %


def term_sketches(df: DataFrame, by: str = "term") -> DataFrame:
    """(``by``, column_name, n_rows, n_null, sketch) of every other column: a mergeable count of distinct values per term."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns if c != by])
    narrow = df.select(by, F.explode(cells).alias("cell")).select(by, "cell.column_name", "cell.value")
    return narrow.groupBy(by, "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("sketch"),
    )


def refresh_sketches(df: DataFrame, path: str, by: str = "term") -> list:
    """Add the sketches of terms that ``path`` does not hold yet, and return these terms.

    Only their rows are read: the filter on ``by`` prunes a table that is stored by it. A term whose rows have changed
    has to be removed from ``path`` first.
    """
    spark = df.sparkSession
    files, place = file_system(spark, path)
    terms = {r[0] for r in df.select(by).distinct().collect() if r[0] is not None}
    known = {r[0] for r in spark.read.parquet(path).select(by).distinct().collect()} if files.exists(place) else set()
    new = sorted(terms - known)
    if new:
        term_sketches(df.filter(F.col(by).isin(new)), by).repartition(1).write.mode("append").partitionBy(by).parquet(path)
    return new


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null, pct_null, n_distinct) over all terms; distinct counts are estimates."""
    return sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"),
        F.try_divide(F.sum("n_null") * 100.0, F.sum("n_rows")).alias("pct_null"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
    )


def sketched_cardinality(df: DataFrame, sketches: DataFrame, texts: Sequence[str], margin: float = 0.1) -> DataFrame:
    """What ``text_cardinality`` gives for ``texts``, from sketches; only columns whose estimate is within ``margin`` of the
    limit are counted in the data."""
    found = sketched_profile(sketches).filter(F.col("column_name").isin(list(texts))).select("column_name", "n_rows", "n_distinct").collect()
    rows = []
    near = [r for r in found if abs(r.n_distinct - min(100.0, r.n_rows * 0.1)) <= margin * min(100.0, r.n_rows * 0.1)]
    exact = {r.column_name: r.n_distinct for r in _distinct_counts(df, [r.column_name for r in near]).collect()} if near else {}
    for r in found:
        limit = min(100.0, r.n_rows * 0.1)
        count = exact.get(r.column_name, r.n_distinct)
        rows.append((r.column_name, int(count), limit, count <= limit))
    return df.sparkSession.createDataFrame(rows, "column_name string, n_distinct bigint, most_allowed double, kept boolean")
