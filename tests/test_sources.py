from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.schema import ACCURACY_SCHEMA, SECTION_SCHEMA
from coursecast.sources import catalog, csv, results, sql_dump
from coursecast.streaming.drop_folder import load_new_files
from tests.conftest import rows

HEADER = "Term,Term Desc,CRN,Subj,XL Act,Big\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_types_and_nulls(spark, tmp_path):
    text = HEADER + '202540,"Spring, ""25""",1,NA,23,' + "x" * 300 + "\n202610,Fall 2025,2,FIN,,y\n"
    path = write(tmp_path / "Course-List (1).csv", text)
    df = csv.load_csv(spark, path)
    assert df.dtypes == [
        ("term", "bigint"), ("term_desc", "string"), ("crn", "bigint"), ("subj", "string"),
        ("xl_act", "double"), ("big", "string"),
    ]
    got = {r.crn: r for r in df.collect()}
    assert got[1].subj is None and got[1].xl_act == 23.0 and got[1].term_desc == 'Spring, "25"'
    assert got[2].xl_act is None and got[2].subj == "FIN"
    kinds = {r["column"]: r["sql_type"] for r in csv.infer_types(csv.read_text_csv(spark, path)).collect()}
    # A whole-number column with gaps is NUMERIC: only a complete one is INTEGER.
    assert kinds == {
        "term": "INTEGER", "term_desc": "VARCHAR(255)", "crn": "INTEGER", "subj": "VARCHAR(255)",
        "xl_act": "NUMERIC", "big": "TEXT",
    }
    assert csv.table_name(path) == "course_list_1"


def test_infer_types_of_typed_columns(spark):
    df = spark.sql("select 1 as i, 1.5D as d, timestamp'2025-01-01' as t, 'a' as s, true as b")
    kinds = [r.sql_type for r in csv.infer_types(df).orderBy("ordinal").collect()]
    assert kinds == ["INTEGER", "NUMERIC", "TIMESTAMP", "VARCHAR(255)", "VARCHAR(255)"]


def test_csv_with_schema_and_empty_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", "term,act\n202540,x\n202540,7\n")
    schema = T.StructType([T.StructField("act", T.IntegerType())])
    assert rows(csv.load_csv(spark, path, schema).select("act")) == [(7,), (None,)]
    with pytest.raises(ValueError, match="missing"):
        csv.load_csv(spark, path, SECTION_SCHEMA)
    with pytest.raises(ValueError, match="empty"):
        csv.load_csv(spark, write(tmp_path / "b.csv", "term,act\n"))


def test_csv_multiline(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'crn,title\n1,"two\nlines"\n')
    assert rows(csv.load_csv(spark, path, multiline=True)) == [(1, "two\nlines")]


def test_csv_directory(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write(folder / "Good One.csv", "term,act\n202540,5\n202610,6\n")
    write(folder / "empty.csv", "term,act\n")
    write(folder / "notes.txt", "not a table")
    outcome = {r.table_name: r.loaded for r in csv.load_csv_dir(spark, str(folder), out).collect()}
    assert outcome == {"good_one": True, "empty": False}
    table = spark.read.parquet(f"{out}/good_one")
    assert rows(table.select("term", "act")) == [(202540, 5), (202610, 6)]


def test_save_table_replaces_and_partitions(spark, tmp_path, sections):
    path = str(tmp_path / "t")
    csv.save_table(sections, path)
    csv.save_table(sections.limit(10), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 10
    assert any(p.name.startswith("term=") for p in (tmp_path / "t").iterdir())


def test_year_floor_prunes_partitions(spark, tmp_path, sections):
    from coursecast.operators.filters import since_year

    path = str(tmp_path / "t")
    csv.save_table(sections, path)
    plan = since_year(spark.read.parquet(path), 1998)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term" in plan and ">= 199800" in plan


NASTY = [
    (1, "O'Brien's; law", 1.5), (2, "ends with );\nINSERT here", None), (3, "a, b) VALUES (x", -2.0),
    (4, None, 0.0), (5, "back\\slash 'q'", 23.0), (6, "", 1.0), (7, "NULL", 2.0),
]


def test_sql_dump_round_trip(spark, tmp_path):
    df = spark.createDataFrame(NASTY, "id int, title string, x double")
    path = str(tmp_path / "dump")
    sql_dump.write_sql_dump(df.coalesce(1), "t", path)
    got = rows(sql_dump.read_sql_dump(spark, f"{path}/data", df.schema))
    assert got == rows(df)
    ddl = "\n".join(r.value for r in spark.read.text(f"{path}/schema").collect())
    assert "CREATE TABLE t (" in ddl and "id INTEGER" in ddl and "x NUMERIC" in ddl


def test_sql_dump_with_ddl_in_the_file(spark, tmp_path):
    text = (
        "-- Table: t\nDROP TABLE IF EXISTS t;\nCREATE TABLE t (\n    id INTEGER,\n    title CHARACTER VARYING\n);\n\n"
        "-- Data for table: t\nINSERT INTO t (id, title) VALUES (1, 'a');\nINSERT INTO t (id, title) VALUES (2, NULL);\n"
    )
    path = write(tmp_path / "t.sql", text)
    schema = T.StructType.fromDDL("id int, title string")
    assert rows(sql_dump.read_sql_dump(spark, path, schema)) == [(1, "a"), (2, None)]


def test_run_query_takes_queries_only(spark, sections):
    df = catalog.run_query(spark, "select count(*) n from {s} where term = :t", {"t": 199940}, s=sections)
    assert df.first().n == sections.filter("term = 199940").count()
    for text in ("drop table x", "insert into x values (1)", "create view v as select 1", "select 1; select 2"):
        with pytest.raises(Exception):
            catalog.run_query(spark, text)


def test_catalog(spark):
    empty = spark.createDataFrame([], "term int, term_desc string")
    small = spark.createDataFrame([("A", 1, 202540, 3)], "subj string, crse int, term int, act int")
    large = spark.range(2500).selectExpr("'A' subj", "1 crse", "202540 term", "3 headcount")
    tables = {"b_small": small, "c_large": large, "a_empty": empty}
    assert catalog.first_table_with(tables, ["term", "term_desc"]) == "a_empty"
    assert catalog.first_table_with(tables, ["nope"]) is None
    roles = catalog.table_roles(tables)
    assert catalog.primary_table(roles).first().table_name == "c_large"
    assert catalog.table_schema(tables)["a_empty"] == {"term": "", "term_desc": ""}
    assert rows(catalog.table_columns(spark, tables))[0] == ("a_empty", 1, "term")
    tie = catalog.table_roles({"z": small, "y": small})
    assert catalog.primary_table(tie).first().table_name == "y"


def test_catalog_tables(spark, sections):
    spark.sql("create database if not exists cc_test")
    csv.save_table(sections.select("term", "act"), "cc_test.t1")
    try:
        tables = catalog.catalog_tables(spark, "cc_test")
        assert list(tables) == ["t1"] and tables["t1"].count() == sections.count()
    finally:
        spark.sql("drop database cc_test cascade")


def test_predictions_files(spark, tmp_path):
    json = '[{"subj": "MIS", "crse": 460, "term": 202540, "prediction": 76.5, "act": 20, "credits": 3, "index": 0}]'
    df = results.read_predictions_json(spark, write(tmp_path / "p.json", json), one_array=True)
    report = results.report_predictions(df)
    row = report.first()
    assert (row.Subject, row.Course, row.Predicted_Enrollment, row.Actual_Enrollment) == ("MIS", "460", 76, 20.0)
    results.write_predictions_csv(report, str(tmp_path / "out"))
    again = results.report_predictions(results.read_predictions_csv(spark, str(tmp_path / "out")))
    assert again.select(sorted(report.columns)).first() == report.select(sorted(report.columns)).first()
    old = "Term,Subject,Course,Section,Credits,Predicted_Enrollment\n202540,AC,210,01,3,40\n"
    row = results.read_predictions_csv(spark, write(tmp_path / "old.csv", old)).first()
    assert (row.term, row.subj, row.crse, row.prediction, row.Section) == (202540, "AC", "210", 40.0, "01")


def test_accuracy_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", "300", 10.0, 2, None, 0.0, 1.0, None)], ACCURACY_SCHEMA)
    results.write_accuracy(df, str(tmp_path / "a"))
    assert rows(results.read_accuracy(spark, str(tmp_path / "a"))) == rows(df)


def test_drop_folder_loads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    schema = T.StructType.fromDDL("term int, `Sec No` string, act int")

    def load():
        load_new_files(spark, str(folder), out, mark, schema)
        return rows(spark.read.parquet(out).select("act", "sec_no"))

    write(folder / "a.csv", "term,Sec No,act\n202540,01,5\n202540,NA,bad\n")
    write(folder / "skip.txt", "term,Sec No,act\n202540,09,9\n")
    assert load() == [(5, "01"), (None, None)]
    assert load() == [(5, "01"), (None, None)]
    write(folder / "b.csv", "term,Sec No,act\n202610,02,7\n")
    assert load() == [(5, "01"), (7, "02"), (None, None)]


def test_drop_folder_rejects_other_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", "act,term\n5,202540\n")
    schema = T.StructType.fromDDL("term int, act int")
    with pytest.raises(Exception):
        load_new_files(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "m"), schema)


def test_normalize_names(spark):
    from coursecast.operators.filters import nan_to_null, normalize_input

    df = normalize_input(spark.sql("select 202540 as TERM, 'A' as Subj"))
    assert df.columns == ["term", "subj", "act", "credits"] and df.first()[2:] == (0, 3)
    assert rows(nan_to_null(spark.sql("select double('NaN') as x, 1 as y"))) == [(None, 1)]
    assert F is not None


DUMP = (
    "INSERT INTO t (id, title) VALUES (1, 'it''s; (a)');\n"
    "INSERT INTO t (id, title) VALUES (2, 'b\nINS');\n"
    "INSERT INTO t (id, title) VALUES (3, NULL);\n"
)
LAYOUTS = {
    "plain": DUMP,
    "crlf": DUMP.replace("\n", "\r\n"),
    "blank lines": DUMP.replace(";\n", ";\n\n"),
    "comments": DUMP.replace(";\n", ";\n-- it's a (comment);\n"),
    "no column list": DUMP.replace(" (id, title) VALUES", " VALUES"),
    "lower case": DUMP.replace("INSERT INTO", "insert into").replace("VALUES", "values"),
    "many tuples": "INSERT INTO t VALUES (1, 'it''s; (a)'),\n (2, 'b\nINS')\n,(3,NULL);",
    "another table": "INSERT INTO u (k) VALUES (9);\n" + DUMP + "INSERT INTO u (k) VALUES (8);\n",
    "column order": DUMP.replace("(id, title)", "(title, id)").replace("(1, 'it''s; (a)')", "('it''s; (a)', 1)")
    .replace("(2, 'b\nINS')", "('b\nINS', 2)").replace("(3, NULL)", "(NULL, 3)"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_sql_dump_layouts(spark, tmp_path, layout):
    (tmp_path / "t.sql").write_text(LAYOUTS[layout], newline="")
    got = sql_dump.read_sql_dump(spark, str(tmp_path), T.StructType.fromDDL("id int, title string"), table="t")
    assert rows(got) == [(1, "it's; (a)"), (2, "b\nINS"), (3, None)]


def test_sql_dump_wrong_number_of_values(spark, tmp_path):
    path = write(tmp_path / "t.sql", "INSERT INTO t (id, title) VALUES (1);\n")
    with pytest.raises(Exception, match="number of values"):
        sql_dump.read_sql_dump(spark, path, T.StructType.fromDDL("id int, title string")).collect()


def test_sql_dump_nan_is_null(spark):
    line = sql_dump.sql_dump_lines(spark.sql("select 1 as id, double('NaN') as x"), "t").first().line
    assert line == "INSERT INTO t (id, x) VALUES (1, NULL);"


def test_long_whole_numbers(spark, tmp_path):
    text = "a,b,c\n1234567890123456789,12345678901234567890123,1234567890123456789\n1234567890123456788,7,\n"
    df = csv.load_csv(spark, write(tmp_path / "ids.csv", text))
    assert [k for _, k in df.dtypes] == ["bigint", "decimal(38,0)", "decimal(38,0)"]
    assert {r.a for r in df.collect()} == {1234567890123456789, 1234567890123456788}
    assert {int(r.b) for r in df.collect()} == {12345678901234567890123, 7}


def test_csv_files_of_two_shapes_are_refused(spark, tmp_path):
    paths = [write(tmp_path / "a.csv", "x,y\n1,2\n"), write(tmp_path / "b.csv", "y,x\n3,4\n")]
    with pytest.raises(Exception, match="header"):
        csv.load_csv(spark, paths)


def test_results_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    write(folder / "a.csv", "Term,Subject,Course,Predicted_Enrollment\n202501,FIN,3010,2\n")
    write(folder / "b.csv", "Predicted_Enrollment,Course,Subject,Term\n5,1010,ACC,202502\n")
    got = results.read_predictions_csv(spark, str(folder)).select("term", "subj", "prediction")
    assert rows(got) == [(202501, "FIN", 2.0), (202502, "ACC", 5.0)]
    path = write(tmp_path / "p.json", '{"term": 202501, "subj": "FIN", "note": "x"}\n')
    assert results.read_predictions_json(spark, path).first().note == "x"
