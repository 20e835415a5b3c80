"""From tables to a trained model."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from coursecast.operators.aggregates import course_term
from coursecast.operators.filters import since_year, training_rows
from coursecast.operators.joins import temporal_join
from coursecast.operators.models import Fitted, fit, save_model
from coursecast.schema import SEASON_SUFFIX
from coursecast.sources.catalog import Tables, catalog_tables, primary_table, run_query, table_roles


def training_data(
    spark: SparkSession,
    query: str | None = None,
    args: Mapping[str, object] | None = None,
    tables: Tables | None = None,
    floor_year: int | None = 2023,
) -> DataFrame:
    """Section rows to train on.

    With ``query`` its result; else the best section table of the catalog, from ``floor_year``
    on, with every other table that has a time column joined to it.
    """
    if query is not None:
        return run_query(spark, query, args, **dict(tables or {}))
    tables = dict(tables if tables is not None else catalog_tables(spark))
    best = primary_table(table_roles(tables)).first() if tables else None
    if best is None:
        raise ValueError("no table with subject, course, semester and enrollment columns")
    sections = tables.pop(best["table_name"])
    return temporal_join(sections, tables, floor_year)


def features_with_context(
    sections: DataFrame, context: Mapping[str, DataFrame], floor_year: int | None = 2023
) -> DataFrame:
    """Feature table with context columns.

    Context depends on the term only, so it is joined after the aggregation: the same result as
    joining it to every section and carrying it through, with far fewer rows in the join.
    """
    return temporal_join(course_term(since_year(sections, floor_year)), context, floor_year)


def model_name(terms: Iterable[int], kind: str, schema: str) -> str:
    """Name by model, features and the range of terms trained on."""
    terms = sorted(terms)
    seasons = {code: name for name, code in SEASON_SUFFIX.items()}

    def label(term: int) -> str:
        suffix = term % 100
        return f"{seasons.get(suffix, f'term{suffix}')}_{term // 100}"

    return f"enrollment_tree_{schema}_{kind}_{label(terms[0])}_to_{label(terms[-1])}"


def train(
    spark: SparkSession,
    sections: DataFrame,
    terms: Sequence[int],
    kind: str = "tree",
    schema: str = "min",
    model_dir: str | None = None,
    act_over: int = 10,
    **options,
) -> Fitted:
    """Train on the sections of some terms; saved under ``model_dir`` when given."""
    data = course_term(training_rows(sections, terms, act_over))
    fitted = fit(data, kind, schema, **options)
    fitted.info.update(name=model_name(terms, kind, schema), terms=sorted(int(t) for t in terms))
    if model_dir:
        save_model(spark, fitted, f"{model_dir}/{fitted.info['name']}")
    return fitted
