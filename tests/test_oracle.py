"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from coursecast.plans.registry import REGISTRY
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def db(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, db, sf, name):
    problems, n_rows, _ = compare(spark, db, name, sf)
    assert not problems
    assert n_rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
