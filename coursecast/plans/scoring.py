"""From a model and rows to predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursecast.functions.names import key_columns, time_keys
from coursecast.operators.aggregates import course_term
from coursecast.operators.filters import nan_to_null, normalize_input, subject_sections
from coursecast.operators.joins import attach_predictions, compare_actual, temporal_join, with_credits
from coursecast.operators.models import Fitted, predict
from coursecast.operators.order import with_position
from coursecast.sources.catalog import run_query
from coursecast.sources.scratch import settle


def score(rows: DataFrame, fitted: Fitted, context: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(keys, features, prediction) of raw rows, one per course and term, or per section.

    The feature table is built as the model's was: of section grain if a section is a feature, with the columns
    of ``context`` tables, and with those that the rows carry themselves. Names match in any case.
    """
    rows = normalize_input(rows)
    asked = [c for c in (*fitted.info.get("key", ()), *fitted.features)]
    features = {c.lower() for c in fitted.features}
    grain = "section" if "sec" in features else "course"
    table = course_term(rows, grain)
    carry = [c for c in rows.columns if c in features - {c.lower() for c in table.columns}]
    if carry:
        table = course_term(rows, grain, carry)
    if context:
        table = temporal_join(table, context, None)
    names = {c.lower(): c for c in asked}
    return predict(table.withColumnsRenamed({c: names[c.lower()] for c in table.columns if c.lower() in names}), fitted)


def score_rows(rows: DataFrame, fitted: Fitted, context: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Every input row with the prediction of its course and term, numbered by ``index``.

    A row whose key is incomplete has no course and term; it stays, without a prediction.

    Predictions are matched by key. The aggregation reorders rows, so a match by position would
    give courses the numbers of others. The rows are written first, so a query runs once.
    """
    rows = settle(normalize_input(rows), "rows")
    scored = attach_predictions(rows, score(rows, fitted, context))
    roles = key_columns(rows.columns)
    keys = [*time_keys(roles), roles["subj"], roles["crse"]]
    tail = [c for c in scored.columns if c not in keys and c != "prediction"]
    return nan_to_null(with_position(scored, [*keys, *tail], "index"))


def score_query(
    spark: SparkSession,
    sql: str,
    fitted: Fitted,
    args: Mapping[str, object] | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Predictions for the rows of a SELECT."""
    return score_rows(run_query(spark, sql, args, **tables), fitted)


def score_course(
    spark: SparkSession, sections: DataFrame, fitted: Fitted, subj: str, crse: int | str, term: int
) -> DataFrame:
    """Prediction for one course in a past or coming term, with the actual total if there is one.

    Credits come from the sections of the course, 3 if it has none on record.
    """
    kinds = {f.name: f.dataType for f in sections.schema.fields}
    one = spark.createDataFrame([(term, subj, str(crse))], "term bigint, subj string, crse string")
    one = one.select([F.col(c).cast(kinds[c]).alias(c) for c in one.columns])
    of_course = sections.filter((F.col("subj") == subj) & (F.col("crse") == F.lit(crse).cast(kinds["crse"])))
    rows = with_credits(one, of_course).withColumn("act", F.lit(0))
    predicted = score(rows, fitted).select("term", "subj", "crse", "credits", "prediction")
    return compare_actual(predicted, of_course, [term])


def score_subject_term(sections: DataFrame, fitted: Fitted, subj: str, term: int) -> DataFrame:
    """Predictions for all courses of a subject in a term."""
    return score(subject_sections(sections, subj, term), fitted)
