"""Feature choice, train/validation split, label encoding and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.functions.courses import bucket, course_number_sql
from coursecast.functions.names import key_columns, time_keys
from coursecast.operators.profile import ID_WORDS, text_cardinality
from coursecast.schema import TARGET

# Columns a model is built from, and those that are always categories. A section
# label only exists in a feature table of section grain.
WANTED = ("term", "subj", "crse", "sec", "credits")
CATEGORIES = ("subj", "sec", "crse")

KEY = ("term", "subj", "crse")

NUMBER_LIKE = (T.NumericType, T.BooleanType, T.DatetimeType)


def row_key(df: DataFrame) -> list[str]:
    """The columns that name a row of a feature table: its time, subject and course, by role."""
    roles = key_columns(df.columns)
    return [*time_keys(roles), *[roles[r] for r in ("subj", "crse") if roles[r]]]


def _wanted(df: DataFrame) -> list[str]:
    """Columns of ``WANTED`` by role, the others by name."""
    roles = key_columns(df.columns)
    names = {c.lower(): c for c in df.columns}
    return [c for c in ((roles[w] if w in KEY else names.get(w)) for w in WANTED) if c]


def min_features(df: DataFrame) -> list[str]:
    """Term (or semester) first, then subject, course and credits as far as they exist."""
    roles = key_columns(df.columns)
    first = [c for c in (roles["term"] or roles["semester"],) if c]
    return list(dict.fromkeys(first + _wanted(df)))


def rich_features(df: DataFrame, id_words: Sequence[str] = ID_WORDS) -> list[str]:
    """The wanted columns, then text of low cardinality, then numbers; no id columns.

    Flags, dates and timestamps count as numbers.
    """
    roles = key_columns(df.columns)
    chosen = [c for c in _wanted(df) if c != roles["enrollment"]]
    skipped = {*chosen, TARGET, roles["enrollment"]}
    rest = [
        f for f in df.schema.fields
        if f.name not in skipped and not any(word in f.name.lower() for word in id_words)
    ]
    texts = {f.name for f in rest if isinstance(f.dataType, T.StringType)}
    others = tuple(c for c in df.columns if c not in texts)
    usable = {r["column_name"] for r in text_cardinality(df, exclude=others).collect() if r["kept"]}
    numbers = [f.name for f in rest if isinstance(f.dataType, NUMBER_LIKE)]
    return chosen + [f.name for f in rest if f.name in usable] + numbers


def select_features(df: DataFrame, schema: str = "min") -> list[str]:
    return min_features(df) if schema == "min" else rich_features(df)


def in_training(percent: int = 80, key: Sequence[str] = KEY) -> Column:
    """Whether a row belongs to the training part.

    A hash of the key decides, so a row stays on its side whatever the partitions or retries.
    """
    return bucket([F.col(c) for c in key], 100) < percent


def split(df: DataFrame, percent: int = 80, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    keep = in_training(percent, key)
    return df.filter(keep), df.filter(~keep)


def categorical(df: DataFrame, features: Sequence[str]) -> list[str]:
    roles = key_columns(df.columns)
    always = {*CATEGORIES, roles["subj"], roles["crse"]}
    return [c for c in features if c in always or isinstance(df.schema[c].dataType, T.StringType)]


def _select(columns: Sequence[str]) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")


def fit_encoding(df: DataFrame, features: Sequence[str], unseen: str = "first") -> PipelineModel:
    """Stages that add ``<column>_code`` for the categorical features.

    The code is the position among the known values sorted as text. A value not seen in ``df``
    gets the code of the first value (``unseen="first"``) or -1 (``"minus_one"``).
    """
    columns = categorical(df, features)
    if not columns:
        return PipelineModel([])
    course = key_columns(df.columns)["crse"]
    texts = _select(
        [f"coalesce({course_number_sql(c) if c == course else f'cast({c} as string)'}, 'None') as {c}_text" for c in columns]
    )
    indexer = StringIndexer(
        inputCols=[f"{c}_text" for c in columns],
        outputCols=[f"{c}_index" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(texts.transform(df))
    other = {"first": 0.0, "minus_one": -1.0}[unseen]
    codes = _select(
        [
            f"case when {c}_index = {len(labels)} then {other}D else {c}_index end as {c}_code"
            for c, labels in zip(columns, indexer.labelsArray)
        ]
    )
    return PipelineModel([texts, indexer, codes])


def _number_sql(df: DataFrame, column: str) -> str:
    """SQL of a column as a double; times count in seconds."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DatetimeType):
        column = f"cast({column} as timestamp)"
    return f"cast({column} as double)"


def scaling(encoded: DataFrame, values: Mapping[str, str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each SQL value by name; a constant one has deviation 1."""
    measures = {name: F.expr(value) for name, value in values.items()}
    row = encoded.agg(
        *[F.avg(v).alias(f"m_{n}") for n, v in measures.items()],
        *[F.stddev_pop(v).alias(f"s_{n}") for n, v in measures.items()],
    ).first()
    return {n: (row[f"m_{n}"], row[f"s_{n}"] or 1.0) for n in values}


def fit_preprocessing(df: DataFrame, features: Sequence[str], unseen: str = "first") -> PipelineModel:
    """Encoding, scaling of all columns, and the ``features`` vector, fitted on ``df``.

    A missing number counts as the mean of ``df``, so it is 0 when scaled.
    """
    encoding = fit_encoding(df, features, unseen)
    codes = categorical(df, features)
    values = {c: f"{c}_code" if c in codes else _number_sql(df, c) for c in features}
    moments = scaling(encoding.transform(df), values)
    scaled = _select(
        [
            f"coalesce(({v} - {moments[c][0] or 0.0!r}D) / {moments[c][1]!r}D, 0D) as {c}_scaled"
            for c, v in values.items()
        ]
    )
    vector = VectorAssembler(inputCols=[f"{c}_scaled" for c in features], outputCol="features")
    return PipelineModel([*encoding.stages, scaled, vector])
