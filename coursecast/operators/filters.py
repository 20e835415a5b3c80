"""Row filters, input normalization and small lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.functions.courses import subject_code
from coursecast.functions.numbers import as_number
from coursecast.functions.terms import term_suffix
from coursecast.schema import DEPARTMENTS, SEASON_SUFFIX, TARGET


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def since_year(df: DataFrame, floor_year: int | None) -> DataFrame:
    """Rows of the academic year ``floor_year`` or later; unchanged without a time column.

    ``term div 100 >= year`` is written as ``term >= year * 100``, which parquet readers and
    partition pruning understand.
    """
    names = {c.lower(): c for c in df.columns}
    if floor_year is None:
        return df
    for name, least in (("year", floor_year), ("term", floor_year * 100)):
        if name in names:
            column = names[name]
            value = F.col(column) if is_numeric(df, column) else as_number(F.col(column))
            return df.filter(value >= least)
    return df


def training_rows(df: DataFrame, terms: Iterable[int], act_over: int = 10) -> DataFrame:
    """Sections of the given terms with more than ``act_over`` students."""
    terms = [int(t) for t in terms]
    if not terms:
        raise ValueError("at least one term is required")
    return df.filter(F.col("term").isin(terms) & (F.col("act") > act_over))


def in_season(df: DataFrame, season: str) -> DataFrame:
    return df.filter(term_suffix(F.col("term")) == SEASON_SUFFIX[season])


def subject_sections(df: DataFrame, subj: str, term: int | None = None) -> DataFrame:
    """Sections of a subject, optionally of one term, by course and section.

    The key of a section ends the sort order, so equal (crse, sec) still spread over tasks.
    """
    wanted = F.col("subj") == subj
    if term is not None:
        wanted = wanted & (F.col("term") == term)
    return df.filter(wanted).orderBy("crse", "sec", "term", "crn")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is null, as tests that parquet readers apply themselves."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def with_target(df: DataFrame, column: str, target: str = TARGET) -> DataFrame:
    """The enrollment column as a number; rows where it is not one are dropped."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        number = F.col(column).cast("bigint")
    else:
        number = as_number(F.col(column).cast("string"))
    return df.withColumn(target, number).filter(F.col(target).isNotNull())


def normalize_input(df: DataFrame, default_credits: int = 3) -> DataFrame:
    """Lower-case names; ``act`` 0 and default credits where those columns are missing."""
    df = df.toDF(*[c.lower() for c in df.columns])
    for column, value in (("act", 0), ("credits", default_credits)):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(value))
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def semesters(df: DataFrame) -> DataFrame:
    """Distinct (term, term_desc), both present, by term."""
    return present(df.select("term", "term_desc"), "term", "term_desc").distinct().orderBy("term", "term_desc")


def department_name(subj: Column, names: Mapping[str, str] = DEPARTMENTS) -> Column:
    """Name of a subject code, null when it has none. The lookup is part of the expression."""
    if not names:
        return F.lit(None).cast("string")
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), subj)


def department_label(
    subj: Column, names: Mapping[str, str] = DEPARTMENTS, fallback: str = "report"
) -> Column:
    """Name of a subject code, else ``"<code> Department"`` (``report``) or the code (``code``)."""
    other = F.concat(subj, F.lit(" Department")) if fallback == "report" else subj
    return F.coalesce(department_name(subj, names), other)


def departments(df: DataFrame, names: Mapping[str, str] = DEPARTMENTS) -> DataFrame:
    """Subjects in use that have a department name, by name."""
    code = subject_code(F.col("subj"))
    return (
        df.select(code.alias("code"))
        .distinct()
        .withColumn("name", department_name(F.col("code"), names))
        .filter("name is not null")
        .orderBy("name")
    )


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Order a result by any column: numbers by value, text without regard to case."""
    key = F.col(column) if is_numeric(df, column) else F.lower(F.col(column).cast("string"))
    return df.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key))
