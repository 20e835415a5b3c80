"""Results on data where one course and term holds a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coursecast.operators import aggregates as A
from coursecast.operators import history, joins
from coursecast.plans import standin

HOT = ("PROMO", 210, 199940)
N = 30_000


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """A third of the rows in one course and term, each with a title of its own."""
    rows = standin.sections(spark, sf)
    extra = spark.range(N).select(
        F.lit(HOT[2]).alias("term"),
        F.lit("Spring 1999").alias("term_desc"),
        (F.col("id") + 10_000_000).alias("crn"),
        F.lit(HOT[0]).alias("subj"),
        F.lit(HOT[1]).alias("crse"),
        F.lit("1").alias("sec"),
        F.lit(3).alias("credits"),
        F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"),
        F.lit(2).alias("act"),
        F.lit(None).cast("double").alias("xl_act"),
    )
    copies = spark.range(10).crossJoin(rows).drop("id")
    return copies.unionByName(extra).cache()


def test_feature_table(skewed, spark, sf):
    subj, crse, term = HOT
    where = (F.col("subj") == subj) & (F.col("crse") == crse) & (F.col("term") == term)
    base = A.course_term(standin.sections(spark, sf).filter(where)).first()
    hot = A.course_term(skewed).filter(where).first()
    assert hot.act_enrollment == 2 * N + 10 * (base.act_enrollment if base else 0)


def test_all_titles_are_kept(skewed):
    conflicts = A.title_conflicts(skewed).filter((F.col("subj") == HOT[0]) & (F.col("crse") == HOT[1]))
    assert conflicts.count() >= N
    assert conflicts.select("title_count").distinct().count() == 1
    assert conflicts.first().title_count == conflicts.count()


def test_row_level_joins(skewed, spark, sf):
    context = {"c": standin.term_context(spark, sf)}
    assert joins.temporal_join(skewed, context, None).count() == skewed.count()
    predictions = history.prior_mean_prediction(A.course_term(skewed))
    attached = joins.attach_predictions(skewed.select("term", "subj", "crse", "crn"), predictions)
    assert attached.count() == skewed.count()
    hot = attached.filter(F.col("crn") >= 10_000_000)
    assert hot.count() == N and hot.select("prediction").distinct().count() == 1


def test_shuffle_join_beyond_the_broadcast_limit(skewed, spark, sf):
    """The same join when the right side is too large to broadcast."""
    predictions = history.prior_mean_prediction(A.course_term(skewed))
    rows = skewed.select("term", "subj", "crse", "crn")
    small = joins.attach_predictions(rows, predictions).agg(F.sum("prediction"), F.count("*")).first()
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for name, value in zip(names, ["-1", "-1", "20KB", "10KB", "2"]):
            spark.conf.set(name, value)
        joined = joins.attach_predictions(rows, predictions)
        large = joined.agg(F.sum("prediction"), F.count("*"))
        got = large.first()
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    assert got[1] == small[1] and got[0] == pytest.approx(small[0])
    assert "SortMergeJoin(skew=true)" in plan
