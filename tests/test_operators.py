from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from coursecast.operators import accuracy, aggregates, history, joins, order, profile, report
from coursecast.plans import reporting, standin, training
from tests.conftest import rows


def sections_of(spark, data, schema="term int, subj string, crse int, act int, credits int"):
    return spark.createDataFrame(data, schema)


# --- feature table ---


def test_course_term_drops_rows_without_key_or_number(spark):
    df = sections_of(
        spark,
        [(202540, "A", 1, 5, 3), (202540, "A", 1, 7, 4), (202540, None, 1, 5, 3), (None, "A", 1, 5, 3),
         (202540, "A", None, 5, 3), (202540, "A", 1, None, 9)],
    )
    assert rows(aggregates.course_term(df)) == [(202540, "A", 1, 12, 4)]


def test_course_term_without_a_term(spark):
    df = spark.createDataFrame(
        [(2025, "fall", "A", 1, "5"), (2025, "fall", "A", 1, "2.5"), (2025, "fall", "A", 1, "x")],
        "year int, semester string, subj string, crse int, enrollment string",
    )
    assert rows(aggregates.course_term(df)) == [(2025, "fall", "A", 1, 7.5)]
    with pytest.raises(ValueError):
        aggregates.course_term(df.drop("enrollment"))


def test_course_term_carry(spark):
    df = sections_of(spark, [(202540, "A", 1, 5, 3), (202540, "A", 1, 7, 4)]).withColumn("x", F.col("act") * 2)
    assert rows(aggregates.course_term(df, carry=["x"])) == [(202540, "A", 1, 12, 4, 14)]
    section = aggregates.course_term(df.withColumn("sec", F.lit("1")), grain="section")
    assert section.count() == 2 and "sec" in section.columns


def test_numeric_series_needs_time(spark):
    df = sections_of(spark, [(202540, "A", 1, 5, 3), (202540, "A", 1, None, 3)])
    assert rows(aggregates.numeric_series(df)) == [(202540, 2, 5, 6)]
    with pytest.raises(ValueError):
        aggregates.numeric_series(df.drop("term"))


def test_checks(spark):
    schema = "term int, crn int, subj string, crse int, title string"
    good = spark.createDataFrame([(1, 1, "A", 1, "x"), (2, 1, "A", 1, "x"), (2, None, "A", 1, None)], schema)
    assert rows(aggregates.verdict(good)) == [("crn_uniqueness", 0, True), ("title_consistency", 0, True)]
    bad = good.union(spark.createDataFrame([(2, 1, "A", 1, "y")], schema))
    assert rows(aggregates.verdict(bad)) == [("crn_uniqueness", 1, False), ("title_consistency", 1, False)]
    assert rows(aggregates.title_conflicts(bad)) == [("A", 1, 2, "x"), ("A", 1, 2, "y")]
    assert rows(aggregates.duplicate_crns(bad)) == [(2, 1, 2)]


def test_forecast_year(spark):
    df = spark.createDataFrame([("202540",), ("202610.0",), ("bad",)], "Term string")
    assert aggregates.forecast_year(df).first()[0] == 2026
    assert aggregates.forecast_year(df.select(F.lit(1).alias("x"))).first()[0] > 2024
    bare = spark.createDataFrame([("A", "1"), ("A", "1")], "Subject string, Course string")
    assert tuple(aggregates.prediction_summary(bare).first()) == (2, 1, None, None)
    assert aggregates.history_years(2026) == [2023, 2024, 2025]
    next_year = spark.sql("select year(current_date()) + 1").first()[0]
    assert aggregates.forecast_year(df.filter("false")).first()[0] == next_year


# --- joins ---


def test_null_keys_match_only_on_request(spark):
    df = spark.createDataFrame([(202540, 1), (None, 2)], "term int, act int")
    context = {"c": spark.createDataFrame([(202540, "a"), (None, "n")], "term int, v string")}
    plain = joins.temporal_join(df, context, floor_year=None)
    assert rows(plain) == [(202540, 1, "a"), (None, 2, None)]
    safe = joins.temporal_join(df, context, floor_year=None, null_safe=True)
    assert rows(safe) == [(202540, 1, "a"), (None, 2, "n")]


def test_several_context_rows_per_key(spark):
    df = sections_of(spark, [(202540, "A", 1, 5, 3)])
    context = {"c": spark.createDataFrame([(202540, 1), (202540, 2)], "term int, v int")}
    reduced = joins.temporal_join(df, context)
    assert rows(reduced.select("act", "c_v")) == [(5, 2)]
    assert aggregates.course_term(reduced).first().act_enrollment == 5
    assert joins.temporal_join(df, context, fan_out=True).count() == 2
    with pytest.raises(Exception, match="several rows"):
        joins.temporal_join(df, context, strict=True).collect()


def test_join_keys_prefer_term_then_year_and_semester(spark):
    df = spark.createDataFrame([(2024, "fall", 1)], "year int, semester string, act int")
    both = spark.createDataFrame([(2024, "fall", 10), (2024, "spring", 20)], "Year int, Semester string, v int")
    only_year = spark.createDataFrame([(2024, 7)], "acad_year int, v int")
    term = spark.createDataFrame([(202410, 7)], "term int, v int")
    context = {"b": both, "y": only_year, "t": term}
    assert joins.joinable(df, context) == {"b": ["Year", "Semester"], "y": ["acad_year"]}
    joined = joins.temporal_join(df, context)
    assert joined.columns == ["year", "semester", "act", "b_v", "acad_year", "y_v"]
    assert rows(joined) == [(2024, "fall", 1, 10, 2024, 7)]


def test_context_year_floor_applies_to_each_side(spark):
    df = spark.createDataFrame([(202240, 1), (202340, 2)], "term int, act int")
    context = {"c": spark.createDataFrame([(202240, 9), (202340, 8)], "term int, v int")}
    assert rows(joins.temporal_join(df, context)) == [(202340, 2, 8)]


def test_context_after_aggregation_equals_context_carried(spark, sf):
    sections, context = standin.sections(spark, sf), {"c": standin.term_context(spark, sf)}
    late = training.features_with_context(sections, context, 1998)
    joined = joins.temporal_join(sections, context, 1998)
    early = aggregates.course_term(joined, carry=["c_n_orders", "c_revenue"])
    assert rows(late.select(early.columns)) == rows(early)


def test_lookups(spark):
    sections = sections_of(spark, [(202540, "A", 1, 10, 3), (202540, "A", 1, 10, 4), (202540, "B", 1, 0, 0)])
    wanted = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1)], "subj string, crse int")
    assert rows(joins.with_credits(wanted, sections)) == [("A", 1, 4), ("B", 1, 3), ("C", 1, 3)]
    predictions = wanted.selectExpr("202540 as term", "*", "15D as prediction")
    compared = {r.subj: (r.total_act, r.error, r.error_pct) for r in joins.compare_actual(predictions, sections).collect()}
    assert compared == {"A": (20, 5.0, 25.0), "B": (0, None, None), "C": (None, None, None)}


# --- order ---


def test_positions_over_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(7)
    got = order.with_position(df, ["g", "id"], "n", start=1).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert [(r.g, r.id) for r in got] == sorted((i % 3, i) for i in range(1000))


def test_positions_keep_clashing_columns(spark):
    df = spark.range(20).select("id", F.lit("p").alias("part"), F.lit("r").alias("row"), F.lit(9).alias("n"))
    got = order.with_position(df, [F.desc("id")], "n")
    assert got.columns == ["n", "id", "part", "row"]
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(k, 19 - k, "p", "r") for k in range(20)]
    assert order.with_position(df.limit(0), ["id"], "n").count() == 0


def test_quantiles_and_positions_sort_nothing_whole(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 1000 - 500.0).alias("x"))
    plan = order.with_position(df, ["x"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "AttachDistributedSequence" not in plan and "SinglePartition" not in plan
    assert order.exact_quantiles(df, "x", {"m": 0.5, "z": 0.999}) == {"m": -0.5, "z": statistics.quantiles(range(-500, 500), n=1000, method="inclusive")[-1]}


@pytest.mark.parametrize("values", [
    [-1e308, -5e-324, -0.0, 0.0, 5e-324, 1e308], [float("-inf"), -2.5, -2.5, 7.0, float("inf")], [3.0], [1.0, 2.0], [5.0, 1.0, 3.0, 3.0, 3.0, 9.0, 7.0], [2.0] * 50 + [1.0]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "id int, x double")
    got = order.exact_quantiles(df, "x", {"a": 0.0, "q": 0.25, "m": 0.5, "z": 1.0})
    ordered = sorted(values)
    place = (len(ordered) - 1) * 0.25
    low = ordered[math.floor(place)]
    quarter = low + (ordered[math.ceil(place)] - low) * (place - math.floor(place))
    assert list(got.values()) == [min(values), quarter, statistics.median(values), max(values)]


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id int, x double")
    assert order.exact_quantiles(df, "x", {"m": 0.5}) == {"m": None}
    assert profile.describe_target(df, "x").first().n == 0


# --- accuracy ---


def test_course_accuracy(spark):
    df = spark.createDataFrame(
        [("A", "1", 10, 12.0), ("A", "1", 20, 15.0), ("B", "1", 0, 3.0), (None, "1", 5, 5.0), ("C", "1", 4, 4.0)],
        "subj string, crse string, actual int, prediction double",
    )
    got = {r.subj: tuple(r)[2:] for r in accuracy.course_accuracy(df).collect()}
    # avg, count, std, variability, mae, mape; variability is from the rounded values
    assert got == {
        "A": (15.0, 2, 7.07, 47.1, 3.5, 22.5),
        "B": (0.0, 1, None, 0.0, 3.0, None),
        "C": (4.0, 1, None, 0.0, 0.0, 0.0),
    }


@pytest.fixture(scope="module")
def acc(spark):
    mapes = [5.0, 15.0, 20.0, 39.99, 40.0, 100.0, 499.0, 500.0, 3000.0, 3001.0, None, None]
    data = [("S", f"{i:02}", 10.0 + i, 2, 1.0, 5.0, 1.0, m) for i, m in enumerate(mapes)]
    schema = (
        "subj string, crse string, avg_enrollment double, predictions_count bigint, "
        "std_enrollment double, variability double, mae double, mape double"
    )
    return spark.createDataFrame(data, schema)


def test_bands_and_histogram(acc):
    assert [(r.band, r.courses) for r in accuracy.accuracy_bands(acc).collect()] == [
        ("good", 2), ("moderate", 2), ("poor", 6),
    ]
    assert accuracy.accuracy_bands(acc).first().pct == pytest.approx(200 / 12)
    # 3000 belongs to the last bin and 3001 to none; empty bins stay.
    assert [r.courses for r in accuracy.mape_histogram(acc).collect()] == [1, 1, 1, 1, 1, 0, 2, 2]


def test_trimmed_mape(acc):
    # Unknown values sort last and take up places: 12 courses leave the best two.
    assert accuracy.trimmed_mape(acc).first() == (12, 2, 10.0)
    few = acc.limit(10).filter("mape <= 20")
    assert accuracy.trimmed_mape(few).first()[1:] == (3, pytest.approx(40 / 3))


def test_summary_rank_and_ends(acc):
    known = [5.0, 15.0, 20.0, 39.99, 40.0, 100.0, 499.0, 500.0, 3000.0, 3001.0]
    row = accuracy.mape_summary(acc).first()
    assert row == (12, pytest.approx(statistics.mean(known)), 70.0)
    ranked = accuracy.ranked_accuracy(acc)
    assert [r.Rank for r in ranked.orderBy("Rank").collect()] == list(range(1, 13))
    assert ranked.filter("Rank > 10").filter("MAPE is null").count() == 2
    assert [r.crse for r in accuracy.worst_courses(acc, 3).collect()] == ["11", "10", "09"]
    assert [r.course for r in accuracy.top_courses(acc, 2).collect()] == ["S 00", "S 01"]
    assert rows(accuracy.from_report(ranked).select(acc.columns)) == rows(acc)
    assert accuracy.median_mape_without_smallest(acc).first() == (11, 100.0)


def test_regression_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0)], "actual int, prediction double")
    row = accuracy.regression_metrics(df).first()
    assert (row.mse, row.mae, row.r2, row.mape) == (5.0, 2.0, None, None)


# --- history ---


def test_history_features(spark):
    df = spark.createDataFrame(
        [(1, "A", 1, 10), (2, "A", 1, 20), (4, "A", 1, 60), (1, "B", 1, 5)],
        "term int, subj string, crse int, act_enrollment bigint",
    )
    got = rows(history.with_history_features(df).filter("subj = 'A'").select("term", "course_mean", "last_term", "trend"))
    assert got == [(1, None, None, None), (2, 10.0, 10, None), (4, 15.0, 20, 10)]
    lagged = history.with_lagged_totals(df).filter("term = 2").first()
    assert (lagged.lagged_program, lagged.lagged_university) == (10, 15)


def test_folds_keep_courses_together(spark, sf):
    df = standin.features(spark, sf).withColumn("fold", history.course_fold(5))
    per_course = df.groupBy("subj", "crse").agg(F.count_distinct("fold").alias("n"))
    assert per_course.filter("n > 1").count() == 0
    assert {r.fold for r in df.select("fold").distinct().collect()} == set(range(5))


# --- profiles and report ---


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3), ("b", 3)], "s string, n int")
    assert rows(profile.feature_profile(df)) == [("n", "int", 1, 25.0, 2), ("s", "string", 1, 25.0, 2)]
    assert profile.sample_values(df, "s").count() == 3
    wide = spark.range(50).selectExpr("cast(id as string) as code", "'x' as kind", "id")
    kept = {r.column_name: r.kept for r in profile.text_cardinality(wide).collect()}
    assert kept == {"code": False, "kind": True}


def test_report_tables(spark, tmp_path):
    sections = sections_of(
        spark,
        [(202310, "FIN", 301, 10, 3), (202440, "FIN", 301, 20, 3), (202540, "FIN", 301, 30, 3),
         (202210, "FIN", 301, 99, 3), (202340, "FIN", 301, None, 3)],
    )
    predictions = spark.createDataFrame(
        [(202610, " fin", "301.0", 25), (202640, " fin", "301.0", 27), (202610, "ENT", "200", None),
         (202610, "ENT", "90", 4), (202610, "FIN", "TBA", 1)],
        "Term int, Subject string, Course string, Predicted_Enrollment int",
    )
    assert rows(report.last_predictions(predictions)) == [("ENT", "90", 4), ("FIN", "301", 27), ("FIN", "TBA", 1)]
    table = report.forecast_table(predictions, sections, [2023, 2024, 2025]).collect()
    assert [(r.department, r.course, r.y2023, r.y2024, r.y2025, r.forecast) for r in table] == [
        (" fin Department", " fin 301.0", 10, 20, 30, 27),
        ("ENT Department", "ENT 90", None, None, None, 4),
        ("ENT Department", "ENT 200", None, None, None, None),
        ("Finance", "FIN TBA", None, None, None, 1),
    ]
    datasets = reporting.report_datasets(predictions, sections)
    reporting.write_report(datasets, str(tmp_path / "r"))
    summary = spark.read.parquet(str(tmp_path / "r/prediction_summary")).first()
    assert tuple(summary) == (5, 4, 57, 57 / 4)


def test_spellings_of_a_course_share_the_forecast(spark):
    sections = sections_of(spark, [(202540, "FIN", 301, 30, 3)])
    predictions = spark.createDataFrame(
        [(202610, "FIN", "301", 25), (202640, "FIN", "301.0", 27)],
        "Term int, Subject string, Course string, Predicted_Enrollment int",
    )
    table = report.forecast_table(predictions, sections, [2025]).collect()
    assert sorted((r.course, r.forecast, r.y2025) for r in table) == [("FIN 301", 27, 30), ("FIN 301.0", 27, 30)]


def test_training_data_discovers_tables(spark):
    tables = {
        "sections": sections_of(spark, [(202540, "A", 1, 5, 3), (202240, "A", 1, 5, 3)]),
        "weather": spark.createDataFrame([(202540, 20.5)], "term int, degrees double"),
        "staff": spark.createDataFrame([("x",)], "name string"),
    }
    assert rows(training.training_data(spark, tables=tables)) == [(202540, "A", 1, 5, 3, 20.5)]
    query = training.training_data(spark, "select * from {sections} where act > :n", {"n": 4}, tables)
    assert query.count() == 2
    with pytest.raises(ValueError):
        training.training_data(spark, tables={"staff": tables["staff"]})


def test_sketches_are_added_per_term(spark, tmp_path):
    path, kept = str(tmp_path / "t"), str(tmp_path / "kept")
    df = spark.range(4000).select((F.col("id") % 4).cast("int").alias("term"), (F.col("id") % 90).cast("string").alias("few"), F.col("id").cast("string").alias("many"),
                                  F.when(F.col("id") % 2 == 0, "x").alias("half"))
    df.write.partitionBy("term").parquet(path)
    stored = spark.read.parquet(path)
    assert profile.refresh_sketches(stored.filter("term < 2"), kept) == [0, 1]
    assert profile.refresh_sketches(stored, kept) == [2, 3] and profile.refresh_sketches(stored, kept) == []
    got = {r.column_name: r for r in profile.sketched_profile(spark.read.parquet(kept)).collect()}
    assert got["few"].n_distinct == pytest.approx(90, rel=0.03) and got["many"].n_distinct == pytest.approx(4000, rel=0.03)
    assert (got["half"].n_null, got["half"].pct_null, got["half"].n_rows) == (2000, 50.0, 4000)
    plan = profile.term_sketches(stored.filter(F.col("term").isin([2])))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term" in plan.replace("\n", "")
    kinds = {r.column_name: (r.n_distinct, r.kept) for r in profile.sketched_cardinality(stored, spark.read.parquet(kept), ["few", "many", "half"]).collect()}
    assert kinds["few"] == (90, True) and kinds["half"] == (1, True) and not kinds["many"][1]  # 90 is near the limit: counted
