"""Numbers out of text.

Text is matched before it is cast: a failed ``try_cast`` raises and catches an exception per
value, which is far slower than a pattern when a column holds many values that are not numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"^\s*[+-]?[0-9]{1,18}\s*$"
LONG_WHOLE = r"^\s*[+-]?[0-9]{1,38}\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


# Blanks, signs, the point and the digits all sort before this character and letters after it,
# so one byte comparison settles most text before a pattern is tried.
_AFTER_DIGITS = ":"


def is_whole(text: Column) -> Column:
    """A whole number that fits a bigint; only the longest need a cast to tell."""
    fits = is_long_whole(text) & (F.length(F.trim(text)) <= 20) & text.try_cast("bigint").isNotNull()
    return (text < _AFTER_DIGITS) & (text.rlike(WHOLE) | fits)


def is_long_whole(text: Column) -> Column:
    """A whole number of up to 38 digits."""
    return (text < _AFTER_DIGITS) & text.rlike(LONG_WHOLE)


def is_number(text: Column) -> Column:
    return (text < _AFTER_DIGITS) & text.rlike(NUMBER)


def as_number(text: Column) -> Column:
    """The value as a double, null where the text is not a number."""
    return F.when(is_number(text), text.try_cast("double"))
