"""Queries on tables of several files, which larger inputs are: rows of their own, a small task for each file."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter

from coursecast.plans import registry

N_FILES = 5


@pytest.fixture
def several_files(spark, tmp_path) -> str:
    """Lines of courses in files of their own."""
    sf = str(tmp_path / "tables")
    parts = [(1, "red bolt", "PROMO", 3), (2, "blue ring", "SMALL", 7)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"{sf}/part.parquet")
    for k in range(N_FILES):
        lines = [(k, 1 + n % 2, n, 2.0 + n, "R" if n % 3 else "N", datetime(1998, 1 + 6 * (n % 2), 3)) for n in range(1, 5)]
        spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp").coalesce(
            1
        ).write.mode("append").parquet(f"{sf}/lineitem.parquet")
    return sf


@pytest.fixture
def folders(monkeypatch) -> dict[str, str]:
    """The scratch folders that a query makes, by name."""
    made, real = {}, registry.scratch_path

    def noted(spark, name):
        made[name] = real(spark, name)
        return made[name]

    monkeypatch.setattr(registry, "scratch_path", noted)
    return made


def test_directory_of_several_files(spark, several_files, folders):
    found = registry.REGISTRY["s5_csv_directory"].build(spark, several_files).collect()
    assert len(list(Path(folders["s5-out"]).glob("part*"))) == N_FILES
    assert [tuple(r) for r in found] == [(4 * N_FILES, 18 * N_FILES)]


def test_counts_by_file_of_several_files(spark, several_files, folders):
    found = registry.REGISTRY["c4_counts_by_file"].build(spark, several_files).collect()
    assert [tuple(r) for r in found] == [(8 * N_FILES, 2, True)]
    assert len(list(Path(folders["c4-table"]).glob("part*"))) == 2 * N_FILES  # the second load is as wide as the first


def test_term_files_are_written_without_a_sort(spark, several_files, monkeypatch):
    spark.createDataFrame([(1, 4)], "n_nationkey int, n_regionkey int").coalesce(1).write.parquet(f"{several_files}/nation.parquet")
    setting, seen, real = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.csv

    def noted(writer, path, *given, **named):
        seen.append(int(spark.conf.get(setting)))
        return real(writer, path, *given, **named)

    monkeypatch.setattr(DataFrameWriter, "csv", noted)
    found = registry.REGISTRY["s5_many_files"].build(spark, several_files).collect()
    assert {r.table_name: r.n_rows for r in found if r.loaded} == {"nation": 1, "spring_1998": 2 * N_FILES, "fall_1998": 2 * N_FILES}
    assert seen[0] > 0 and int(spark.conf.get(setting)) == 0
