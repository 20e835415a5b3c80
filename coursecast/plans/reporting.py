"""The report datasets as tables on storage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from coursecast.operators.accuracy import accuracy_bands, mape_histogram, mape_summary, top_courses
from coursecast.operators.aggregates import forecast_year, history_years, prediction_summary
from coursecast.operators.report import forecast_table
from coursecast.schema import DEPARTMENTS


def report_datasets(
    report: DataFrame,
    sections: DataFrame,
    accuracy: DataFrame | None = None,
    names: Mapping[str, str] = DEPARTMENTS,
) -> dict[str, DataFrame]:
    """The datasets of a report by name. ``report`` has report column names."""
    year = forecast_year(report).first()["forecast_year"]
    datasets = {
        "prediction_summary": prediction_summary(report),
        "forecast_table": forecast_table(report, sections, history_years(year), names),
    }
    if accuracy is not None:
        datasets |= {
            "accuracy": accuracy,
            "accuracy_bands": accuracy_bands(accuracy),
            "mape_summary": mape_summary(accuracy),
            "mape_histogram": mape_histogram(accuracy),
            "top_courses": top_courses(accuracy),
        }
    return datasets


def write_report(datasets: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in datasets.items():
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")
