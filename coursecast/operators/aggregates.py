"""Aggregations over sections. Every group is pre-aggregated before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.functions.names import key_columns, time_keys
from coursecast.functions.terms import term_code, term_year, whole_term
from coursecast.operators.filters import present, since_year, with_target
from coursecast.schema import TARGET


def course_term(df: DataFrame, grain: str = "course", carry: Sequence[str] = ()) -> DataFrame:
    """The feature table: enrollment of each course in each term.

    Sums the enrollment and takes the largest credits; ``carry`` keeps further columns by their
    largest value. Rows without a key or a numeric enrollment are dropped. ``grain="section"``
    keeps one row per section instead.
    """
    roles = key_columns(df.columns)
    if not (roles["subj"] and roles["crse"] and roles["enrollment"] and (roles["term"] or roles["semester"])):
        raise ValueError("need subject, course, term or semester, and enrollment columns")
    keys = [*time_keys(roles), roles["subj"], roles["crse"]]
    credits = [c for c in df.columns if c.lower() == "credits"]
    rows = present(with_target(df, roles["enrollment"]), *keys)
    if grain == "section":
        section = [c for c in df.columns if c.lower() == "sec"]
        return rows.select(*keys, *section, TARGET, *credits, *carry)
    largest = [F.max(c).alias(c) for c in dict.fromkeys([*credits, *carry])]
    return rows.groupBy(*keys).agg(F.sum(TARGET).alias(TARGET), *largest)


def course_total(df: DataFrame, subj: str, crse: int | str, term: int) -> DataFrame:
    """Total enrollment of one course in one term; null when it was not taught."""
    one = (F.col("subj") == subj) & (F.col("crse") == crse) & (F.col("term") == term)
    return df.filter(one).agg(F.sum("act").alias("total_act"))


def prediction_input(
    df: DataFrame, year: int, season: str, subj: str | None = None, least: int = 10
) -> DataFrame:
    """Courses to predict: those of one term with at least ``least`` students."""
    rows = df.filter(F.col("term") == term_code(year, season))
    if subj is not None:
        rows = rows.filter(F.col("subj") == subj)
    return (
        rows.groupBy("term", "subj", "crse")
        .agg(F.sum("act").alias("act"), F.avg("credits").alias("credits"))
        .filter(F.col("act") >= least)
    )


def enrollment_by_term(df: DataFrame, floor_year: int | None = 2023) -> DataFrame:
    """Total enrollment of each term, in term order."""
    total = F.sum(F.coalesce("act", F.lit(0))).alias("total_enrollment")
    return since_year(df, floor_year).groupBy("term", "term_desc").agg(total).orderBy("term", "term_desc")


def numeric_series(df: DataFrame) -> DataFrame:
    """Sum of every numeric column per term (or year), in time order."""
    key = next((k for k in ("term", "year") if k in df.columns), None)
    if key is None:
        raise ValueError("the result needs a 'term' or 'year' column")
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != key
    ]
    if not numeric:
        raise ValueError("no numeric columns to sum")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numeric]
    return present(df, key).groupBy(key).agg(*sums).orderBy(key)


def _history_rows(df: DataFrame, years: Iterable[int]) -> DataFrame:
    """Sections with an enrollment in the given academic years."""
    years = sorted(years)
    rows = present(df, "act")
    if isinstance(df.schema["term"].dataType, T.NumericType):
        # A range on the stored column prunes files; the exact years are checked below.
        rows = rows.filter(F.col("term").between(years[0] * 100, years[-1] * 100 + 99))
    year = term_year(whole_term(df, "term"))
    return rows.withColumn("hist_year", year).filter(F.col("hist_year").isin(years))


def history_by_year(df: DataFrame, years: Iterable[int], pairs: DataFrame | None = None) -> DataFrame:
    """Enrollment per course and academic year, optionally for the courses in ``pairs`` only.

    The restriction follows the aggregation: it then meets one row per course and year.
    """
    total = F.sum("act").alias("total_enrollment")
    history = _history_rows(df, years).groupBy("subj", "crse", "hist_year").agg(total)
    if pairs is not None:
        history = history.join(pairs.select("subj", "crse"), ["subj", "crse"], "left_semi")
    return history


def history_pivot(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """One row per course with a column ``y<year>`` for each year, in one aggregation."""

    def of_year(year: int) -> Column:
        return F.sum(F.when(F.col("hist_year") == year, F.col("act"))).alias(f"y{year}")

    return _history_rows(df, years).groupBy("subj", "crse").agg(*[of_year(y) for y in years])


def title_conflicts(df: DataFrame) -> DataFrame:
    """Courses with several titles: (subj, crse, title_count, title), a row per title.

    Titles stay rows, so a course with any number of them is never one cell of one task.
    """
    titles = present(df.select("subj", "crse", "title"), "subj", "crse", "title").distinct()
    counts = titles.groupBy("subj", "crse").agg(F.count("title").alias("title_count"))
    return titles.join(counts.filter("title_count > 1"), ["subj", "crse"]).select(
        "subj", "crse", "title_count", "title"
    )


def duplicate_crns(df: DataFrame) -> DataFrame:
    """Section ids used more than once within a term."""
    return (
        present(df, "term", "crn")
        .groupBy("term", "crn")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
        .filter("occurrence_count > 1")
    )


def verdict(df: DataFrame) -> DataFrame:
    """(check_name, n_bad, passed) for the title and section-id checks."""
    # Two titles differ exactly when the smallest and the largest do: no distinct needed.
    courses = (
        present(df, "subj", "crse", "title")
        .groupBy("subj", "crse")
        .agg((F.min("title") != F.max("title")).alias("bad"))
        .agg(F.count_if("bad").alias("n_bad"))
    )
    crns = duplicate_crns(df).agg(F.count(F.lit(1)).alias("n_bad"))
    checks = [("title_consistency", courses), ("crn_uniqueness", crns)]
    rows = [c.select(F.lit(name).alias("check_name"), "n_bad") for name, c in checks]
    return rows[0].unionByName(rows[1]).withColumn("passed", F.col("n_bad") == 0)


def distinct_courses(df: DataFrame) -> DataFrame:
    return df.select("subj", "crse").distinct()


def prediction_summary(report: DataFrame) -> DataFrame:
    """Predictions, distinct courses, predicted total and average of report predictions."""
    if "Predicted_Enrollment" not in report.columns:
        report = report.withColumn("Predicted_Enrollment", F.lit(None).cast("bigint"))
    # Counted per course first: the totals add up from those rows and no course is one big group.
    per_course = report.groupBy("Subject", "Course").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("Predicted_Enrollment").alias("n_known"),
        F.sum("Predicted_Enrollment").alias("total"),
    )
    return per_course.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        F.count(F.lit(1)).alias("unique_courses"),
        F.sum("total").alias("predicted_total"),
        F.try_divide(F.sum("total"), F.sum("n_known")).alias("predicted_average"),
    )


def forecast_year(report: DataFrame, term: str = "Term") -> DataFrame:
    """Latest academic year among the predicted terms, else the next calendar year."""
    year = term_year(whole_term(report, term)) if term in report.columns else F.lit(None)
    latest = F.coalesce(F.max(year), F.year(F.current_date()) + 1)
    return report.agg(latest.alias("forecast_year"))


def history_years(year: int, count: int = 3) -> list[int]:
    return [y for y in range(year - count, year) if y > 0]

