"""The datasets of the forecast report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursecast.functions.courses import course_number, course_sort_key, students, subject_code
from coursecast.operators.aggregates import history_pivot
from coursecast.operators.filters import department_label
from coursecast.operators.joins import with_history
from coursecast.schema import DEPARTMENTS


def _recency(report: DataFrame) -> Column:
    """A prediction with what orders it, latest largest."""
    return F.struct(*[c for c in ("Term", "index") if c in report.columns], "Predicted_Enrollment")


def last_predictions(report: DataFrame) -> DataFrame:
    """(subj, crse, forecast) with the latest prediction of each course, as whole students.

    Latest means the last term, then the last index; predictions without a value do not count.
    """
    return (
        report.filter("Predicted_Enrollment is not null")
        .groupBy(
            subject_code(F.col("Subject")).alias("subj"), course_number(F.col("Course")).alias("crse")
        )
        .agg(students(F.max(_recency(report))["Predicted_Enrollment"]).alias("forecast"))
        .filter("subj is not null and crse is not null")
    )


def forecast_table(
    report: DataFrame,
    sections: DataFrame,
    years: Sequence[int],
    names: Mapping[str, str] = DEPARTMENTS,
    fallback: str = "report",
) -> DataFrame:
    """Forecast and yearly history of every predicted course, by department and course number.

    Sections and predictions are each aggregated to one row per course before they are joined.
    A course may be spelled in several ways; each spelling is a row with the course's forecast.
    """
    history = history_pivot(sections, years).withColumn("crse", F.col("crse").cast("string"))
    latest = F.max(F.when(F.col("Predicted_Enrollment").isNotNull(), _recency(report)))
    spellings = Window.partitionBy("subj", "crse")
    known = F.col("subj").isNotNull() & F.col("crse").isNotNull()
    forecast = F.max("latest").over(spellings)["Predicted_Enrollment"]
    courses = (
        report.filter("Subject is not null")
        .groupBy("Subject", "Course")
        .agg(latest.alias("latest"))
        .withColumns({"subj": subject_code(F.col("Subject")), "crse": course_number(F.col("Course"))})
        .withColumn("forecast", F.when(known, students(forecast)))
    )
    return (
        with_history(courses, history)
        .select(
            F.col("Subject").alias("subject"),
            department_label(F.col("Subject"), names, fallback).alias("department"),
            F.concat_ws(" ", "Subject", F.col("Course").cast("string")).alias("course"),
            course_sort_key(F.col("Course")).alias("course_order"),
            *[f"y{y}" for y in years],
            "forecast",
        )
        .orderBy("subject", F.asc_nulls_last("course_order"), "course")
    )
