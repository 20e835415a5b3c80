from __future__ import annotations

import os

import pytest

from coursecast.plans import standin
from coursecast.session import session

SF = os.environ.get("COURSECAST_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("scratch")
    spark = session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__checkpoint__dir=str(scratch),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def sections(spark, sf):
    return standin.sections(spark, sf).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
