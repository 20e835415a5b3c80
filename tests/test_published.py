"""Figures of the published section data and accuracy runs.

The files are not part of this repository. COURSECAST_SECTION_DUMP names the SQL dump and COURSECAST_ACCURACY_RUNS the
folder of accuracy CSVs; without them a folder beside the repository is searched.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coursecast.operators import accuracy as ACC
from coursecast.operators import aggregates as A
from coursecast.operators import filters as FL
from coursecast.operators import models as M
from coursecast.schema import SECTION_SCHEMA
from coursecast.sources import results, sql_dump
from tests.conftest import rows



def _beside(pattern: str) -> str | None:
    """The first file of a name pattern below the folders beside the repository's."""
    here = Path(__file__).resolve().parents[1]
    try:
        folders = [p for p in sorted(here.parent.iterdir()) if p.is_dir() and not p.is_symlink() and p != here and not p.name.startswith(".")]
        return next((str(f) for p in folders for f in sorted(p.glob(pattern))), None)
    except OSError:  # the folders beside the repository cannot be read
        return None


DUMP = os.environ.get("COURSECAST_SECTION_DUMP") or _beside("*/data/sql/*section*.sql")
_RUN = _beside("*/*/*/*/per_course_accuracy_tree_*.csv")
RUNS = os.environ.get("COURSECAST_ACCURACY_RUNS") or (_RUN and str(Path(_RUN).parent))
needs_dump = pytest.mark.skipif(not DUMP, reason="no section dump on this machine")
needs_runs = pytest.mark.skipif(not RUNS, reason="no accuracy runs on this machine")


@pytest.fixture(scope="module")
def published(spark):
    return sql_dump.read_sql_dump(spark, DUMP, SECTION_SCHEMA).cache()


@needs_dump
def test_rows(published):
    one = published.agg(
        F.count("*"), F.count_distinct("subj"), F.count_distinct("subj", "crse"), F.count_distinct("crn"), F.sum("act"),
        F.count_if(F.col("act") == 0), F.count_if(F.col("act") > 10), F.count("xl_act"),
    ).first()
    assert tuple(one) == (2050, 9, 168, 818, 49687, 70, 1680, 208)
    assert dict(rows(published.groupBy("term").count())) == {
        202140: 244, 202210: 199, 202240: 192, 202310: 191, 202340: 197, 202410: 191, 202440: 195, 202510: 198,
        202540: 210, 202610: 233,
    }
    assert dict(rows(published.groupBy("subj").count())) == {
        "AC": 421, "FIN": 382, "MGT": 378, "MKT": 305, "MIS": 224, "BUS": 148, "LAW": 77, "MC": 66, "ENT": 49,
    }


@needs_dump
def test_feature_table(published):
    recent = FL.since_year(published, 2023)
    assert recent.count() == 1415
    assert A.course_term(published).count() == 987
    assert A.course_term(recent).count() == 694


@needs_dump
def test_checks(published):
    conflicts = A.title_conflicts(published)
    assert conflicts.select("subj", "crse").distinct().count() == 20
    assert [r.title for r in conflicts.filter("subj = 'AC' and crse = 390").orderBy("title").collect()] == [
        "Topics: Fraud Lab", "Tpcs: Fraud Lab",
    ]
    duplicates = rows(A.duplicate_crns(published))
    assert len(duplicates) == 12
    assert (202140, 44329, 2) in duplicates and (202240, 40280, 4) in duplicates
    assert rows(A.verdict(published)) == [("crn_uniqueness", 12, False), ("title_consistency", 20, False)]


@needs_dump
def test_totals(published):
    totals = {r.term: r.total_enrollment for r in A.enrollment_by_term(published).collect()}
    assert totals == {
        202310: 4868, 202340: 4521, 202410: 4652, 202440: 4725, 202510: 5051, 202540: 5365, 202610: 6139,
    }
    for season, groups, total in (("spring", 86, 5290), ("fall", 82, 4979)):
        rows_ = A.prediction_input(published, 2025, season)
        assert rows_.agg(F.count("*"), F.sum("act")).first() == (groups, total)
    history = A.history_pivot(published, [2023, 2024, 2025]).filter("subj = 'FIN' and crse = 301")
    assert tuple(history.first()) == ("FIN", 301, 151, 143, 121)
    assert A.course_total(published, "MIS", 460, 202540).first().total_act == 20


@needs_dump
def test_departments_leave_out_the_unnamed(published):
    found = [r.code for r in FL.departments(published).collect()]
    assert "ENT" not in found and len(found) == 8


@needs_dump
def test_forest_reaches_the_targets(published):
    data = A.course_term(published.filter("act > 10"))
    fitted = M.fit(data, "tree", grid={"numTrees": (100,), "maxDepth": (30,)})
    report = {r.part: r for r in M.fit_report(data, fitted).collect()}
    assert report["validation"].r2 > 0.5
    assert report["validation"].mape < 50


# run file ending: courses, predictions, mean MAE, mean / median / trimmed MAPE, bands
FIGURES = {
    "20251203_185628": (88, 161, 18.58, 50.96, 21.68, 23.45, (40, 24, 24)),
    "20251204_173022": (79, 145, 15.01, 43.73, 22.78, 22.60, (38, 23, 18)),
    "20251204_184919": (85, 163, 19.56, 44.15, 25.68, 22.55, (36, 33, 16)),
    "20251209_181033": (86, 145, 23.70, 91.35, 21.34, 23.71, (41, 22, 23)),
    "20251213_013805": (99, 177, 22.28, 365.49, 30.22, 38.89, (30, 32, 35)),
    "20251213_015932": (84, 148, 22.85, 79.37, 19.59, 19.68, (43, 26, 15)),
    "20251213_015936": (99, 177, 22.28, 365.59, 30.24, 38.86, (31, 32, 34)),
}


@needs_runs
@pytest.mark.parametrize("run", FIGURES)
def test_accuracy_runs(spark, run):
    path = next(str(p) for p in Path(RUNS).glob(f"*_{run}.csv"))
    acc = ACC.from_report(results.read_accuracy(spark, path))
    courses, predictions, mae, mean, median, trimmed, bands = FIGURES[run]
    sums = acc.agg(F.sum("predictions_count"), F.avg("mae")).first()
    assert (sums[0], round(sums[1], 2)) == (predictions, mae)
    summary = ACC.mape_summary(acc).first()
    assert (summary.courses, round(summary.mean_mape, 2)) == (courses, mean)
    assert summary.median_mape == pytest.approx(median, abs=0.00501)
    assert ACC.trimmed_mape(acc).first().trimmed_mape == pytest.approx(trimmed, abs=0.00501)
    assert tuple(r.courses for r in ACC.accuracy_bands(acc).collect()) == bands
