"""Section data derived from the star-schema test tables.

One order line is one class section: ship date gives the term, the part its course and title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coursecast.operators.aggregates import course_term
from coursecast.operators.filters import since_year
from coursecast.operators.history import prior_mean_prediction

FLOOR_YEAR = 1998  # the test tables run from 1995 to 2001

# Names for five of the six part types; the sixth has none on purpose.
NAMES = {
    "PROMO": "Promotion Studies",
    "ECONOMY": "Economics",
    "STANDARD": "Standards",
    "MEDIUM": "Media",
    "SMALL": "Small Business",
}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is looked up once, as a catalog would keep it."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _term(date: Column) -> Column:
    spring = F.month(date) <= 6
    return F.when(spring, F.year(date) * 100 + 40).otherwise((F.year(date) + 1) * 100 + 10)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    date = F.col("l_shipdate")
    season = F.when(F.month(date) <= 6, "Spring ").otherwise("Fall ")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        _term(date).alias("term"),
        F.concat(season, F.year(date).cast("string")).alias("term_desc"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("crn"),
        F.col("p_type").alias("subj"),
        (F.col("p_size") + 200).alias("crse"),
        F.col("l_linenumber").cast("string").alias("sec"),
        (F.col("p_size") % 4 + 1).alias("credits"),
        F.col("p_name").alias("title"),
        F.col("l_quantity").cast("int").alias("act"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("xl_act"),
    )


def _order_totals(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    term = _term(F.col("o_orderdate"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .select(
            term.alias("term"),
            (term / 100).cast("int").alias("year"),
            (term % 100).alias("semester"),
            F.col("o_orderpriority").alias("priority"),
            "o_totalprice",
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_orders"), total.alias("revenue"))
    )


def term_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_totals(spark, sf_dir, "term")


def year_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_totals(spark, sf_dir, "year", "semester")


def repeated_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per term."""
    return _order_totals(spark, sf_dir, "term", "priority")


STORED = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part",
    "region", "supplier",
)


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Section data, context tables and all stored tables, by name."""
    return {
        **{name: table(spark, sf_dir, name) for name in STORED},
        "sections": sections(spark, sf_dir),
        "term_context": term_context(spark, sf_dir),
        "year_context": year_context(spark, sf_dir),
    }


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_term(since_year(sections(spark, sf_dir), FLOOR_YEAR))


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_term(sections(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course and term that has a prediction: the course mean of its earlier terms."""
    return prior_mean_prediction(all_features(spark, sf_dir)).filter("prediction is not null")
