"""Column names: cleaning them and finding what each one means."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

# Words that give a column its role, tried in this order for each column.
CONTAINS = {
    "subj": ("subj",),
    "crse": ("crse",),
    "term": (),
    "semester": ("semester",),
    "year": ("year",),
    "enrollment": ("enrollment", "headcount"),
}
EQUALS = {"crse": "course", "term": "term", "enrollment": "act"}


def clean_name(name: str) -> str:
    """Lower case, separators as single underscores, no parentheses."""
    return re.sub(r"_+", "_", re.sub(r"[ \-./\\]", "_", re.sub(r"[()]", "", name.lower()))).strip("_")


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def _fits(role: str, name: str, has_crse: bool) -> bool:
    if any(word in name for word in CONTAINS[role]):
        return True
    # A column named "course" stands in only where no "crse" column exists.
    return EQUALS.get(role) == name and not (role == "crse" and has_crse)


def key_columns(columns: Iterable[str]) -> dict[str, str | None]:
    """Column of each role. The first fitting column wins and a column takes one role."""
    columns = list(columns)
    has_crse = "crse" in [c.lower() for c in columns]
    roles: dict[str, str | None] = dict.fromkeys(CONTAINS)
    for column in columns:
        for role, taken in roles.items():
            if taken is None and _fits(role, column.lower(), has_crse):
                roles[role] = column
                break
    return roles


def role_flags(columns: Iterable[str]) -> dict[str, bool]:
    """Which roles a table can serve. Looser than :func:`key_columns`: any column may count."""
    names = [c.lower() for c in columns]

    def any_has(*words: str) -> bool:
        return any(word in name for name in names for word in words)

    term = "term" in names
    return {
        "has_subj": any_has("subj"),
        "has_crse": any_has("crse", "course"),
        "has_term": term,
        "has_semester": term or any_has("semester"),
        "has_year": term or any_has("year"),
        "has_enrollment": "act" in names or any_has("enrollment", "headcount"),
    }


def time_keys(roles: dict[str, str | None]) -> list[str]:
    """Columns that give a row its time: the term, else year and semester."""
    if roles["term"]:
        return [roles["term"]]
    return [roles[r] for r in ("year", "semester") if roles[r]]
