"""SQL dumps: one INSERT statement per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.sources.sql_lexer import insert_rows

_DDL_TYPES = (
    (T.IntegralType, "INTEGER"),
    (T.NumericType, "NUMERIC"),
    (T.TimestampType, "TIMESTAMP"),
    (T.TimestampNTZType, "TIMESTAMP"),
)


def _literal(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    text = c.cast("string")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = F.when(~F.isnan(c), text)
    if not isinstance(field.dataType, T.NumericType):
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def _value(cell: Column, kind: T.DataType, name: str, strict: bool) -> Column:
    """A cell's value: text has a quote in front and no other mark."""
    text = F.when(cell.startswith("'"), F.substring(cell, F.lit(2), F.length(cell))).otherwise(cell)
    value = text.try_cast(kind)
    if not strict or isinstance(kind, T.StringType):
        return value
    wrong = F.raise_error(F.concat(F.lit(f"not a value of {name} ({kind.simpleString()}): "), text)).cast(kind)
    return F.when(value.isNotNull() | text.isNull(), value).otherwise(wrong)


def sql_dump_lines(df: DataFrame, table: str) -> DataFrame:
    """One column ``line``: an INSERT per row. Quotes are doubled and nulls are NULL."""
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    values = F.concat_ws(", ", *[_literal(f) for f in df.schema.fields])
    return df.select(F.concat(F.lit(head), values, F.lit(");")).alias("line"))


def sql_dump_ddl(schema: T.StructType, table: str) -> str:
    def ddl_type(field: T.StructField) -> str:
        for kind, name in _DDL_TYPES:
            if isinstance(field.dataType, kind):
                return name
        return "CHARACTER VARYING"

    columns = ",\n".join(
        f"    {f.name} {ddl_type(f)}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields
    )
    return f"DROP TABLE IF EXISTS {table};\nCREATE TABLE {table} (\n{columns}\n);\n"


def write_sql_dump(df: DataFrame, table: str, path: str) -> None:
    """``path/schema`` holds the DDL and ``path/data`` the INSERTs, in as many parts as tasks."""
    spark = df.sparkSession
    ddl = spark.createDataFrame([(sql_dump_ddl(df.schema, table),)], "line string")
    ddl.coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    sql_dump_lines(df, table).write.mode("overwrite").text(f"{path}/data")


def _plain_name(name: Column | str) -> Column:
    """A table or column name without its schema and quotes, in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(F.trim(name), ".", -1), '["`\\s]', ""))


def read_sql_dump(
    spark: SparkSession, path: str, schema: T.StructType, table: str | None = None, strict: bool = True
) -> DataFrame:
    """Rows of the INSERT statements in dump files; other statements and comments are skipped.

    Any layout goes: one or many tuples per statement, over any number of lines or on one, with comments between,
    nested parentheses, and quotes, semicolons or whole statements inside of texts. A statement of any size is read by many
    tasks. Values go to ``schema`` by the statement's column list, by position if it has none; a column that the list
    leaves out is null. ``table`` keeps the statements of one table. Literals are decoded (doubled quotes, ``E''``,
    ``$$``, a type before or behind); any other expression stays as its text in a text column.

    A row with another number of values than columns is an error, and so is a value that is none of its column's
    type, unless ``strict`` is off: it is null then. No row is left out: see ``insert_rows`` for what else is an error.
    """
    found = insert_rows(spark, path)
    if table is not None:
        found = found.filter(_plain_name("table") == _plain_name(F.lit(table)))
    given = F.transform(F.split("columns", ","), _plain_name)
    own = F.array(*[F.lit(f.name.lower()) for f in schema.fields])
    as_written = F.lit(", ".join(f.name.lower() for f in schema.fields))  # by far the most: no names to take apart
    plain = all(f.name.isidentifier() for f in schema.fields)
    by_place = F.col("columns").isNull() | (F.col("columns") == as_written) & F.lit(plain)
    rows = found.select(F.when(by_place, own).otherwise(given).alias("names"), "cells")
    shown = F.array_join(F.transform("cells", lambda c: F.ltrim(c, F.lit("'"))), ", ", "NULL")
    wrong = F.raise_error(F.concat(F.lit("the number of values is not that of the columns: ("), shown, F.lit(")")))
    rows = rows.select("names", F.when(F.size("names") == F.size("cells"), F.col("cells")).otherwise(wrong).alias("cells"))

    def cell(field: T.StructField) -> Column:
        return F.get("cells", (F.array_position("names", field.name.lower()) - 1).cast("int"))

    return rows.select([_value(cell(f), f.dataType, f.name, strict).alias(f.name) for f in schema.fields])
