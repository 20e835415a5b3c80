"""Term codes: ``YYYYSS`` with suffix 10 for fall and 40 for spring.

Fall carries the *next* calendar year (202210 is fall 2021), so ``YYYY`` is an academic year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.functions.numbers import as_number
from coursecast.schema import SEASON_SUFFIX


def term_number(term: Column) -> Column:
    """A term given as text or with decimals as a whole number; null for what is not one."""
    return as_number(term.cast("string")).try_cast("bigint")


def whole_term(df: DataFrame, name: str) -> Column:
    """A term column as whole numbers: itself if stored so, else parsed."""
    column = F.col(name)
    return column if isinstance(df.schema[name].dataType, T.IntegralType) else term_number(column)


def term_year(term: Column) -> Column:
    """Academic year of a whole term code, null when it is not positive."""
    return F.when(term > 0, F.floor(term / 100)).cast("int")


def term_suffix(term: Column) -> Column:
    return term % 100


def calendar_year(term: Column) -> Column:
    """Year in which the term is taught."""
    fall = term_suffix(term) == SEASON_SUFFIX["fall"]
    return term_year(term) - F.when(fall, 1).otherwise(0)


def season(term: Column) -> Column:
    """``fall``, ``spring``, or ``term<suffix>`` for any other code."""
    suffix = term_suffix(term)
    names = [F.when(suffix == code, name) for name, code in SEASON_SUFFIX.items()]
    return F.coalesce(*names, F.concat(F.lit("term"), suffix.cast("string")))


def term_label(term: Column) -> Column:
    """Season and academic year, as used in model names."""
    return F.concat_ws("_", season(term), term_year(term).cast("string"))


def term_code(year: int, season_name: str) -> int:
    return year * 100 + SEASON_SUFFIX[season_name]
