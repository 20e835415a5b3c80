"""Course history features. Input: one row per course and term (the feature table).

A window over a course holds at most one row per term, so its size is bounded by the number
of terms, not by the number of sections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursecast.functions.courses import bucket
from coursecast.functions.terms import calendar_year, season, term_suffix, term_year, whole_term
from coursecast.schema import SEASON_SUFFIX, TARGET
from coursecast.sources.scratch import settle

COURSE = ("subj", "crse")


def with_history_features(features: DataFrame) -> DataFrame:
    """Adds the course mean over earlier terms, last-term enrollment and two-term trend."""
    course = Window.partitionBy(*COURSE).orderBy("term")
    earlier = course.rowsBetween(Window.unboundedPreceding, -1)
    last, before = F.lag(TARGET, 1).over(course), F.lag(TARGET, 2).over(course)
    return features.withColumns(
        {
            "course_mean": F.avg(TARGET).over(earlier),
            "last_term": last,
            "trend": last - before,
        }
    )


def prior_mean_prediction(features: DataFrame) -> DataFrame:
    """Feature rows with the course mean of earlier terms as the prediction; null at first."""
    return with_history_features(features).select(
        "term", *COURSE, "credits", F.col(TARGET).alias("actual"), F.col("course_mean").alias("prediction")
    )


def with_term_parts(df: DataFrame) -> DataFrame:
    """Academic and calendar year, season code and one 0/1 column per season."""
    term = whole_term(df, "term")
    one_hot = {
        f"is_{name}": (term_suffix(term) == code).cast("int") for name, code in SEASON_SUFFIX.items()
    }
    return df.withColumns(
        {
            "academic_year": term_year(term),
            "calendar_year": calendar_year(term),
            "semester_code": term_suffix(term).cast("int"),
            "season": season(term),
            **one_hot,
        }
    )


def class_size_bucket(size: Column, splits: Sequence[int] = (15, 30, 60, 120)) -> Column:
    """Index of the size class: 0 below the first split, up to len(splits)."""
    return sum(((size >= s).cast("int") for s in splits), F.lit(0))


def course_fold(n_folds: int, columns: Sequence[str] = COURSE) -> Column:
    """Fold 0..n-1 that keeps all rows of a course together."""
    return bucket([F.col(c) for c in columns], n_folds, seed="fold")


def with_lagged_totals(
    features: DataFrame, groups: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Adds ``lagged_<name>``: the group's enrollment in its previous term.

    By default the groups are the subject (program) and everything (university); a table with
    school columns passes its own. Totals have one row per group and term, and a group's
    window as many rows as there are terms. Features and totals are written once: the sections
    are scanned a single time, and the join back is a broadcast as long as the files of the
    totals are small, so the feature table is not shuffled on few terms.
    """
    groups = {"program": ["subj"], "university": []} if groups is None else groups
    features = settle(features, "features")
    stored = features
    for name, by in groups.items():
        totals = stored.groupBy(*by, "term").agg(F.sum(TARGET).alias("__total"))
        one_group = [*by] or [F.lit(1)]
        order = Window.partitionBy(*one_group).orderBy("term")
        lagged = totals.select(*by, "term", F.lag("__total").over(order).alias(f"lagged_{name}"))
        features = features.join(settle(lagged, f"lagged-{name}"), [*by, "term"], "left")
    return features


def enrollment_trend(features: DataFrame, last_year: int, spans: Sequence[int] = (5, 10)) -> DataFrame:
    """Students gained per year by each course over the ``spans`` years up to ``last_year``."""
    year, students = F.col("year"), F.col("total").cast("double")
    yearly = (
        features.withColumn("year", term_year(whole_term(features, "term")))
        .filter(F.col("year").between(last_year - max(spans) + 1, last_year))
        .groupBy(*COURSE, "year")
        .agg(F.sum(TARGET).alias("total"))
    )

    def slope(span: int) -> Column:
        inside = year > last_year - span
        x = F.when(inside, year.cast("double"))
        return F.regr_slope(F.when(inside, students), x).alias(f"trend_{span}y")

    return yearly.groupBy(*COURSE).agg(*[slope(s) for s in spans])
