"""Joins: context by time, lookups by course, forecasts with actuals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursecast.functions.names import key_columns, time_keys
from coursecast.operators.filters import since_year
from coursecast.sources.scratch import settle


def join_keys(left: DataFrame, right: DataFrame) -> list[tuple[str, str]]:
    """Column pairs that join two tables in time: the term, else year and/or semester."""
    ours, theirs = key_columns(left.columns), key_columns(right.columns)
    if ours["term"] and theirs["term"]:
        return [(ours["term"], theirs["term"])]
    return [(ours[r], theirs[r]) for r in ("year", "semester") if ours[r] and theirs[r]]


def _one_row_per_key(df: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """One whole row of the table per key: the largest by its other columns in their order, nulls least."""
    values = [c for c in df.columns if c not in keys]
    row = F.max(F.struct(*values)) if values else F.lit(None).cast("struct<>")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"), row.alias("__row"))
    if strict:
        unique = F.assert_true(F.col("__copies") == 1, F.lit(f"several rows for one key of {keys}"))
        grouped = grouped.filter(unique.isNull())
    return grouped.select(*keys, *[F.col("__row")[c].alias(c) for c in values])


def temporal_join(
    df: DataFrame,
    context: Mapping[str, DataFrame],
    floor_year: int | None = 2023,
    strict: bool = False,
    fan_out: bool = False,
    null_safe: bool = False,
) -> DataFrame:
    """Left-join context tables on their time columns, in name order.

    Context columns become ``<table>_<column>``; tables without a common key are left out.
    A context table is brought to one of its rows per key first (the largest), because several would
    multiply the sections; ``strict`` makes them an error and ``fan_out`` keeps them: then each
    section appears once for every context row of its key, so a term's rows multiply. The reduced table is written once, so the join is a broadcast while its files are
    small and a shuffle join with skew handling beyond that. ``null_safe`` matches null keys.
    """
    df = since_year(df, floor_year)
    for name in sorted(context):
        related = since_year(context[name], floor_year)
        keys = join_keys(df, related)
        if not keys:
            continue
        right_keys = [r for _, r in keys]
        if not fan_out:
            related = settle(_one_row_per_key(related, right_keys, strict), f"context-{name}")
        renamed = {c: f"{name}_{c}" for c in related.columns if c not in right_keys}
        # Keys get private names for the join; the reader keeps the left ones.
        private = {r: f"__key_{r}" for r in right_keys}
        related = related.withColumnsRenamed({**renamed, **private})
        on = [_equal(F.col(l), F.col(private[r]), null_safe) for l, r in keys]
        df = df.join(related, on, "left")
        kept = {private[r]: r for l, r in keys if r.lower() != l.lower()}
        df = df.withColumnsRenamed(kept).drop(*[p for p in private.values() if p not in kept])
    return df


def _equal(left: Column, right: Column, null_safe: bool) -> Column:
    return left.eqNullSafe(right) if null_safe else left == right


def joinable(df: DataFrame, context: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Context tables that share a time column with ``df``, and the columns they join on."""
    pairs = {name: join_keys(df, related) for name, related in sorted(context.items())}
    return {name: [r for _, r in keys] for name, keys in pairs.items() if keys}


def attach_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Input rows with the prediction of their course and term, matched by key.

    Predictions are written once: small files are broadcast and the rows stay where they are;
    larger ones are joined by shuffle, where adaptive execution splits a hot course.
    """
    roles = key_columns(predictions.columns)
    section = [c for c in predictions.columns if c.lower() == "sec" and c.lower() in map(str.lower, rows.columns)]
    keys = [*time_keys(roles), roles["subj"], roles["crse"], *section]
    return rows.join(settle(predictions.select(*keys, "prediction"), "predictions"), keys, "left")


def with_history(predictions: DataFrame, history: DataFrame) -> DataFrame:
    """Predictions with the history columns of their course, null where it has none."""
    return predictions.join(history, ["subj", "crse"], "left")


def compare_actual(
    predictions: DataFrame, sections: DataFrame, terms: Sequence[int] | None = None
) -> DataFrame:
    """Forecast next to the enrolled total of the same course and term.

    Errors are null where no student is enrolled or the course was not taught. ``terms``, when the
    predicted terms are known, limits the scan of the sections to them.
    """
    keys = ["term", "subj", "crse"]
    if terms is not None:
        sections = sections.filter(F.col("term").isin(list(terms)))
    totals = sections.groupBy(*keys).agg(F.sum("act").alias("total_act"))
    error = F.when(F.col("total_act") > 0, F.abs(F.col("prediction") - F.col("total_act")))
    return (
        predictions.join(totals, keys, "left")
        .withColumn("error", error)
        .withColumn("error_pct", F.col("error") / F.col("total_act") * 100)
    )


def with_credits(courses: DataFrame, sections: DataFrame, default: int = 3) -> DataFrame:
    """Courses with the largest credits on record; the default for none or zero."""
    known = sections.groupBy("subj", "crse").agg(F.max("credits").alias("__credits"))
    credits = F.coalesce(F.nullif(F.col("__credits"), F.lit(0)), F.lit(default))
    return courses.join(known, ["subj", "crse"], "left").withColumn("credits", credits).drop("__credits")
