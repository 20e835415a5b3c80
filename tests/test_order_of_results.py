"""Results whose order is part of the result come in that order."""

from __future__ import annotations

from coursecast.operators import aggregates, filters, report
from coursecast.plans import standin
from coursecast.plans.registry import _report


def test_subject_sections(sections):
    got = [(r.crse, r.sec, r.crn) for r in filters.subject_sections(sections, "MEDIUM", 199940).select("crse", "sec", "crn").collect()]
    assert len(got) > 10 and got == sorted(got)


def test_sorted_result(spark, sf):
    scored = standin.scored(spark, sf)
    subjects = [r.subj.lower() for r in filters.sort_by(scored, "subj", descending=True).select("subj").collect()]
    assert subjects == sorted(subjects, reverse=True)
    numbers = [r.prediction for r in filters.sort_by(scored, "prediction").select("prediction").collect()]
    assert numbers == sorted(numbers)


def test_forecast_table(spark, sf, sections):
    table = report.forecast_table(_report(spark, sf), sections, aggregates.history_years(2002), standin.NAMES)
    got = [(r.subject, r.course_order, r.course) for r in table.collect()]
    assert len(got) > 50 and got == sorted(got)
