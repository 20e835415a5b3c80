from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coursecast.functions import courses, names, terms
from coursecast.operators import filters
from tests.conftest import rows


def values(spark, kind, data, expression):
    df = spark.createDataFrame([(v,) for v in data], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_term_year_of_text(spark):
    texts = ["202540", "202540.0", " 202310 ", "202540.9", "0", "-202540", "", "abc", "NaN", None]
    assert values(spark, "string", texts, lambda t: terms.term_year(terms.term_number(t))) == [
        2025, 2025, 2023, 2025, None, None, None, None, None, None,
    ]


def test_fall_belongs_to_the_next_academic_year(spark):
    assert values(spark, "int", [202210, 202140], terms.term_year) == [2022, 2021]
    assert values(spark, "int", [202210, 202140], terms.calendar_year) == [2021, 2021]


def test_season(spark):
    assert values(spark, "int", [202210, 202140, 202130], terms.season) == ["fall", "spring", "term30"]
    assert values(spark, "int", [202210], terms.term_label) == ["fall_2022"]
    assert terms.term_code(2025, "spring") == 202540


def test_subject_code(spark):
    assert values(spark, "string", [" fin ", "MIS", "  ", None], courses.subject_code) == ["FIN", "MIS", None, None]


def test_course_number(spark):
    texts = ["300", "300.0", " 300 ", "300.5", "3e2", "300H", "", None, "1e400", "Infinity"]
    want = ["300", "300", "300", "300.5", "300", "300H", None, None]
    assert values(spark, "string", texts, courses.course_number)[:8] == want
    assert values(spark, "double", [300.0, 300.5], courses.course_number) == ["300", "300.5"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    both = df.select(courses.course_number(F.col("x")).alias("a"), F.expr(courses.course_number_sql("x")).alias("b"))
    assert both.filter("not (a <=> b)").count() == 0


def test_course_sort_key(spark):
    texts = ["300", "300.0", "300H", "TBA", None]
    assert values(spark, "string", texts, courses.course_sort_key) == [300, 300, 300, None, None]


def test_half_even(spark):
    assert values(spark, "double", [0.5, 1.5, 2.5, 2.51, None], courses.students) == [0, 2, 2, 3, None]
    assert values(spark, "double", [0.125, 0.375], lambda x: courses.half_even(x, 2)) == [0.12, 0.38]


def test_clean_name():
    assert names.clean_name(" Term  Desc. ") == "term_desc"
    assert names.clean_name("XL-(Act)/\\No.") == "xl_act_no"
    assert names.clean_name("__A__b__") == "a_b"


def test_key_columns():
    roles = names.key_columns(["TERM", "Subj_Code", "Crse", "Course", "Total_Headcount", "act", "Year"])
    assert roles == {
        "subj": "Subj_Code", "crse": "Crse", "term": "TERM", "semester": None, "year": "Year",
        "enrollment": "Total_Headcount",
    }
    assert names.key_columns(["course", "semester_year"])["crse"] == "course"
    assert names.key_columns(["semester_year"]) | {} == names.key_columns(["semester_year"])
    # One column takes one role, so this one is the semester only.
    assert names.key_columns(["semester_year"])["year"] is None
    assert names.key_columns(["course_title"])["crse"] is None
    assert names.role_flags(["course_title"])["has_crse"]


def test_year_floor_uses_year_before_term(spark):
    df = spark.createDataFrame([(202540, 2020), (202240, 2024)], "term int, Year int")
    assert rows(filters.since_year(df, 2023)) == [(202240, 2024)]
    text = spark.createDataFrame([("202540",), ("202240",), ("bad",)], "TERM string")
    assert rows(filters.since_year(text, 2023)) == [("202540",)]
    plain = spark.createDataFrame([(1,)], "x int")
    assert filters.since_year(plain, 2023).count() == 1


def test_with_target_drops_what_is_no_number(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,), ("NaN",), ("1.5",)], "act string")
    assert [r.act_enrollment for r in filters.with_target(df, "act").collect()] == [12.0, 1.5]


def test_department_names(spark):
    subj = F.col("x")
    labels = values(spark, "string", ["MIS", "ENT"], lambda c: filters.department_label(c))
    assert labels == ["Management Information Systems", "ENT Department"]
    assert values(spark, "string", ["ENT"], lambda c: filters.department_label(c, fallback="code")) == ["ENT"]
    df = spark.createDataFrame([(" mis ",), ("ENT",), (None,)], "subj string")
    assert rows(filters.departments(df)) == [("MIS", "Management Information Systems")]
    assert subj is not None


def test_sort_by(spark):
    df = spark.createDataFrame([("b", 2), ("A", 10), (None, 1)], "s string, n int")
    assert [r.s for r in filters.sort_by(df, "s").collect()] == ["A", "b", None]
    assert [r.n for r in filters.sort_by(df, "n", descending=True).collect()] == [10, 2, 1]


def test_training_rows_need_terms(spark):
    df = spark.createDataFrame([(202540, 10), (202540, 11)], "term int, act int")
    assert rows(filters.training_rows(df, [202540])) == [(202540, 11)]
    with pytest.raises(ValueError):
        filters.training_rows(df, [])
