"""How good predictions are: per course, in bands, and over all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursecast.functions.courses import half_even
from coursecast.operators.filters import present
from coursecast.operators.order import exact_quantiles, with_position
from coursecast.schema import GOOD_BELOW, MAPE_EDGES, MAPE_LABELS, POOR_FROM, REPORT_NAMES
from coursecast.sources.scratch import settle

BEST_FIRST = ("mape asc nulls last", "subj", "crse")
WORST_FIRST = ("mape desc nulls first", "subj desc", "crse desc")


def _order(terms: Sequence[str]) -> list[Column]:
    """Sort columns from texts such as ``"mape desc nulls first"``."""
    columns = []
    for term in terms:
        name, _, way = term.partition(" ")
        columns.append(getattr(F, way.replace(" ", "_") or "asc")(name))
    return columns


def errors(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """Adds abs_error and pct_error; the latter is null where nobody is enrolled."""
    miss = F.abs(F.col(actual) - F.col(predicted))
    share = F.when(F.col(actual) > 0, F.try_divide(miss, F.col(actual)) * 100)
    return df.withColumns({"abs_error": miss, "pct_error": share})


def course_accuracy(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row per course, from scored rows with subj, crse, actual and predicted columns.

    Means are rounded to cents; variability is the ratio of the *rounded* deviation and mean.
    """
    rounded = {
        "avg_enrollment": F.avg(actual),
        "std_enrollment": F.stddev_samp(actual),
        "mae": F.avg("abs_error"),
        "mape": F.avg("pct_error"),
    }
    stats = (
        errors(present(df, "subj", "crse"), actual, predicted)
        .groupBy("subj", "crse")
        .agg(
            F.count(actual).alias("predictions_count"),
            *[half_even(value, 2).alias(name) for name, value in rounded.items()],
        )
    )
    spread = F.try_divide(F.col("std_enrollment"), F.col("avg_enrollment")) * 100
    return stats.select(
        "subj", "crse", "avg_enrollment", "predictions_count", "std_enrollment",
        half_even(F.coalesce(spread, F.lit(0.0)), 1).alias("variability"), "mae", "mape",
    )


def ranked_accuracy(accuracy: DataFrame) -> DataFrame:
    """Report table: courses ranked 1..n by MAPE, unknown last, ties by course."""
    ranked = with_position(accuracy, _order(BEST_FIRST), "Rank", start=1)
    return ranked.select(
        "Rank",
        F.col("subj").alias(REPORT_NAMES["subj"]),
        F.col("crse").alias(REPORT_NAMES["crse"]),
        F.col("avg_enrollment").alias("Avg_Enrollment"),
        F.col("predictions_count").alias("Num_Predictions"),
        F.col("std_enrollment").alias("Std_Enrollment"),
        F.col("variability").alias("Variability_Pct"),
        F.col("mae").alias("MAE"),
        F.col("mape").alias("MAPE"),
    )


def from_report(report: DataFrame) -> DataFrame:
    """A ranked report table in the column names of :func:`course_accuracy`."""
    names = {
        "Subject": "subj", "Course": "crse", "Avg_Enrollment": "avg_enrollment",
        "Num_Predictions": "predictions_count", "Std_Enrollment": "std_enrollment",
        "Variability_Pct": "variability", "MAE": "mae", "MAPE": "mape",
    }
    return report.drop("Rank").withColumnsRenamed(names)


def best_courses(accuracy: DataFrame, n: int = 10) -> DataFrame:
    return accuracy.orderBy(*_order(BEST_FIRST)).limit(n)


def worst_courses(accuracy: DataFrame, n: int = 10) -> DataFrame:
    """The end of the ranking; courses without a MAPE count as worst."""
    return accuracy.orderBy(*_order(WORST_FIRST)).limit(n)


def top_courses(accuracy: DataFrame, n: int = 10) -> DataFrame:
    """Chart rows (course, mape) of the most predictable courses."""
    label = F.concat_ws(" ", "subj", F.col("crse").cast("string"))
    return best_courses(accuracy.filter("mape is not null"), n).select(
        label.alias("course"), half_even(F.col("mape"), 2).alias("mape")
    )


def accuracy_bands(accuracy: DataFrame) -> DataFrame:
    """(band, courses, pct): good, moderate and poor courses and their share of all.

    A course without a MAPE is in no band but counts towards the total.
    """
    mape = F.col("mape")
    bands = {
        "good": mape < GOOD_BELOW,
        "moderate": (mape >= GOOD_BELOW) & (mape < POOR_FROM),
        "poor": mape >= POOR_FROM,
    }
    total = F.count(F.lit(1))
    cells = [
        F.struct(
            F.lit(name).alias("band"),
            F.count_if(test).alias("courses"),
            F.try_divide(F.count_if(test) * 100.0, total).alias("pct"),
        )
        for name, test in bands.items()
    ]
    return accuracy.agg(F.array(*cells).alias("bands")).select(F.inline("bands"))


def mape_histogram(accuracy: DataFrame) -> DataFrame:
    """(bin, mape_range, courses); empty bins stay, the last bin includes its upper edge."""
    mape = F.col("mape")
    cells = []
    for i, label in enumerate(MAPE_LABELS):
        low, high = MAPE_EDGES[i], MAPE_EDGES[i + 1]
        below = mape <= high if i == len(MAPE_LABELS) - 1 else mape < high
        cells.append(
            F.struct(
                F.lit(i + 1).alias("bin"),
                F.lit(label).alias("mape_range"),
                F.count_if((mape >= low) & below).alias("courses"),
            )
        )
    return accuracy.agg(F.array(*cells).alias("bins")).select(F.inline("bins"))


def mape_summary(accuracy: DataFrame) -> DataFrame:
    """(courses, mean_mape, median_mape); courses without a MAPE are counted but not averaged."""
    stored = settle(accuracy.select("mape"), "mape")
    median = exact_quantiles(stored, "mape", {"m": 0.5})["m"]
    return stored.agg(
        F.count(F.lit(1)).alias("courses"),
        F.avg("mape").alias("mean_mape"),
        F.lit(median).cast("double").alias("median_mape"),
    )


def trimmed_mape(accuracy: DataFrame, drop: int = 10) -> DataFrame:
    """(courses, kept, trimmed_mape): mean MAPE without the last ``drop`` courses.

    Courses without a MAPE sort last and use up places. Nothing is dropped from ``drop`` courses
    or fewer. Only the dropped rows are broadcast, never more than ``drop``.
    """
    last = worst_courses(accuracy, drop).select("subj", "crse", F.lit(True).alias("__last"))
    marked = accuracy.join(F.broadcast(last), ["subj", "crse"], "left")
    total, keep = F.count(F.lit(1)), F.col("__last").isNull()
    kept_mean = F.avg(F.when(keep, F.col("mape")))
    return marked.agg(
        total.alias("courses"),
        F.when(total > drop, F.count_if(keep)).otherwise(total).alias("kept"),
        F.when(total > drop, kept_mean).otherwise(F.avg("mape")).alias("trimmed_mape"),
    )


def median_mape_without_smallest(accuracy: DataFrame, share: float = 0.05) -> DataFrame:
    """(courses, median_mape) of the courses at or above the ``share`` quantile of class size."""
    stored = settle(accuracy.select("avg_enrollment", "mape"), "mape")
    cut = exact_quantiles(stored, "avg_enrollment", {"q": share})["q"]
    kept = stored.filter(F.col("avg_enrollment") >= F.lit(cut).cast("double"))
    median = exact_quantiles(kept, "mape", {"m": 0.5})["m"]
    return kept.agg(
        F.count(F.lit(1)).alias("courses"), F.lit(median).cast("double").alias("median_mape")
    )


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "prediction"
) -> DataFrame:
    """mse, rmse, mae, r2 and mape (rows with students only) in one aggregation."""
    y, p = F.col(actual).cast("double"), F.col(predicted)
    square = (y - p) * (y - p)
    mse = F.avg(square)
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            mse.alias("mse"),
            F.sqrt(mse).alias("rmse"),
            F.avg(F.abs(y - p)).alias("mae"),
            (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
            (F.avg(F.when(y > 0, F.try_divide(F.abs(y - p), y))) * 100).alias("mape"),
        )
    )
