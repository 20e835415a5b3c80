"""Folders of CSV files, tables that are replaced, and files of several shapes that arrive in one folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursecast.sources import csv
from coursecast.streaming.drop_folder import load_mixed_files
from tests.conftest import rows


def test_many_files_few_jobs(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(60):
        (folder / f"t{k:02}.csv").write_text(f"Id,Some Name,Term\n{k},x{k},202540\n{k + 1},\"a,\"\"b\",202510\n")
    for k in range(60, 70):
        (folder / f"t{k}.csv").write_text(f"﻿name,value\ny,{k}.5\nNULL,2\n")
    group = "folder-load"
    spark.sparkContext.setJobGroup(group, group)
    outcome = csv.load_csv_dir(spark, str(folder), out).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert len(outcome) == 70 and all(r.loaded for r in outcome) and jobs < 25
    got = spark.read.parquet(f"{out}/t07")
    assert rows(got.select("id", "some_name", "term")) == [(7, "x7", 202540), (8, 'a,"b', 202510)]
    assert dict(got.dtypes)["id"] == "bigint"
    assert rows(spark.read.parquet(f"{out}/t65")) == [("y", 65.5), (None, 2.0)]


def test_files_that_cannot_be_loaded(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    cases = {
        "a b": "x,y\n1,2\n", "a-b": "x,y\n3,4\n", "empty": "", "header": "x,y\n", "long": "x,y\n1,2,3\n", "same": "x,X\n1,2\n", "plus+": "x\n5\n", "short": "x,y,z\n1\n",
    }
    for name, text in cases.items():
        (folder / f"{name}.csv").write_text(text)
    outcome = rows(csv.load_csv_dir(spark, str(folder), out).select("table_name", "loaded"))
    assert outcome == sorted([
        ("a_b", True), ("a_b", False), ("empty", False), ("header", False), ("long", False), ("same", False), ("plus+", True), ("short", True),
    ], key=repr)
    assert rows(spark.read.parquet(f"{out}/a_b")) == [(1, 2)]  # the first by name
    assert rows(spark.read.parquet(f"{out}/plus+")) == [(5,)]
    assert rows(spark.read.parquet(f"{out}/short")) == [(1, None, None)]
    (folder / "a b.csv").write_text("x,y\n7,8\n")
    csv.load_csv_dir(spark, str(folder), out)
    assert rows(spark.read.parquet(f"{out}/a_b")) == [(7, 8)]
    assert not list((tmp_path / "out").glob(".load*")) and not list((tmp_path / "out").glob("*.old*"))


def test_a_load_that_fails_leaves_the_old_table(spark, tmp_path):
    target = str(tmp_path / "t" / "sections")
    csv.save_table(spark.range(5).withColumn("term", F.lit(202540)), target)
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).cast("bigint").alias("id"), F.lit(1).alias("term"))
    with pytest.raises(Exception, match="stop"):
        csv.save_table(broken, target)
    assert spark.read.parquet(target).count() == 5
    csv.save_table(spark.read.parquet(target).filter("id > 2"), target)  # from itself
    assert rows(spark.read.parquet(target).select("id")) == [(3,), (4,)]
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["sections"]


def test_a_catalog_table_is_replaced(spark):
    csv.save_table(spark.range(3), "replaced_t")
    csv.save_table(spark.range(7), "replaced_t")
    assert spark.table("replaced_t").count() == 7
    spark.sql("drop table replaced_t")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("replaced_t")]


def test_mixed_drop_folder(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    shapes = {
        "people": T.StructType.fromDDL("id int, name string"),
        "marks": T.StructType([T.StructField("Id", T.IntegerType()), T.StructField("The Mark", T.DoubleType())]),
    }
    (folder / "a.csv").write_text("id,name\n1,x\nbad,y\n")
    (folder / "b c.csv").write_text("Name,ID\nz,2\n")
    (folder / "m.csv").write_text("id,the mark\n1,2.5\n")
    (folder / "odd.csv").write_text("what,is,this\n1,2,3\n")
    load_mixed_files(spark, str(folder), out, mark, shapes)
    (folder / "late.csv").write_text("id,name\n3,w\n")
    (folder / "wide.csv").write_text("id,name\n4,v,extra\n")
    for _ in range(2):
        load_mixed_files(spark, str(folder), out, mark, shapes)
    assert rows(spark.read.parquet(f"{out}/people").select("id", "name")) == [(1, "x"), (2, "z"), (3, "w"), (None, "y")]
    assert rows(spark.read.parquet(f"{out}/marks").select("id", "the_mark")) == [(1, 2.5)]
    rejected = {r.file.split("/")[-1]: r.reason for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert set(rejected) == {"odd.csv", "wide.csv"} and "more values" in rejected["wide.csv"]


def test_counts_are_kept_by_file(spark, tmp_path):
    from coursecast.sources import catalog

    path, kept = str(tmp_path / "a table"), str(tmp_path / "kept")
    spark.range(10).withColumn("k", F.lit("a b+c%")).repartition(2).write.partitionBy("k").parquet(path)
    assert sum(r.n_rows for r in catalog.counted_files(spark.read.parquet(path), kept).collect()) == 10
    spark.range(5).withColumn("k", F.lit("z")).coalesce(1).write.mode("append").partitionBy("k").parquet(path)
    assert sum(r.n_rows for r in catalog.counted_files(spark.read.parquet(path), kept).collect()) == 15
    assert spark.read.parquet(kept).count() == 3
    spark.range(2).withColumn("k", F.lit("y")).coalesce(1).write.mode("overwrite").partitionBy("k").parquet(path)
    assert [r.n_rows for r in catalog.counted_files(spark.read.parquet(path), kept).collect()] == [2]
