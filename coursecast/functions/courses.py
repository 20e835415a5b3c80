"""Subject codes, course numbers and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursecast.functions.numbers import NUMBER, as_number


def subject_code(subj: Column) -> Column:
    """Trimmed upper-case code, null when empty."""
    return F.nullif(F.upper(F.trim(subj)), F.lit(""))


def course_number_sql(name: str) -> str:
    """SQL text of :func:`course_number`, for ML stages that take SQL."""
    text = f"trim(cast({name} as string))"
    number = f"case when {text} rlike r'{NUMBER}' then try_cast({text} as double) end"
    whole = f"try_cast({number} as bigint)"
    return f"case when {whole} = {number} then cast({whole} as string) else nullif({text}, '') end"


def course_number(crse: Column) -> Column:
    """Whole numbers as plain digits (``300.0`` -> ``300``), other text trimmed, empty as null."""
    text = F.trim(crse.cast("string"))
    number = as_number(text)
    whole = number.try_cast("bigint")
    return F.when(whole == number, whole.cast("string")).otherwise(F.nullif(text, F.lit("")))


def course_sort_key(crse: Column) -> Column:
    """The digits of a course number as a number; null (sort it last) when there are none."""
    digits = F.regexp_replace(course_number(crse), "[^0-9]", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled double, the way numpy does."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale if digits else F.rint(value)


def students(value: Column) -> Column:
    """Whole students: half-even, as an integer."""
    return half_even(value.cast("double")).cast("bigint")


def bucket(columns: list[Column], n: int, seed: str = "") -> Column:
    """Stable bucket 0..n-1 of a key. Depends on the key only, not on partitions or retries."""
    parts = [F.lit(seed)] if seed else []
    digest = F.md5(F.concat_ws("|", *parts, *[c.cast("string") for c in columns]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n).cast("int")
