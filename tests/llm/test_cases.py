"""Defined results for nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coursecast.llm import registry
from coursecast.llm.decontaminate import clean_documents, leaks
from coursecast.llm.html_text import main_text
from coursecast.llm.mixing import mixed_documents, pareto_mix
from coursecast.llm.quality import good_documents, quality
from coursecast.llm.rules import quality_rules
from coursecast.llm.simhash import near_components, without_near_copies
from coursecast.llm.substrings import without_repeats
from coursecast.llm.tokens import token_index
from coursecast.llm.toxicity import toxicity
from coursecast.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3),
    (5, LONG, "en", "b", len(LONG)), (6, "tie tie tie", "en", "c", 11), (6, "tie tie tie", "en", "c", 11),
    (None, "no id here", "en", None, 10), (8, "x" * 50_000, "de", "a", 50_000), (9, "É ñ 日本 \U0001f600", "es", "a", 8),
]
PAGES = "page_id long, url string, html string"
WEB = [
    (1, None, None), (2, "no scheme", ""), (3, "HTTP://Ex.ORG?x", "<p>a<p>b"), (None, "https://a.com/de/1", "<div"),
    (3, "HTTP://Ex.ORG?x", "<p>a<p>b"), (5, "://", "&lt;&#233;&nbsp;x<br>y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The cases, with columns whose names the operators use themselves."""
    more = ["fp", "size", "row", "uid", "score", "kept", "copies", "passage", "words", "_size", "_text", "_id", "_rows", "_dirty", "_taken", "_copies",
            "root", "stays_id", "mix_id", "mix_words", "dirty_uid"]
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in more])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "too few words"), (None, "no id " * 9)], "item_id long, text string")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=repr)


OPERATORS = {
    "mixing": lambda d, l, b, t: pareto_mix(d),
    "tokens": lambda d, l, b, t: token_index(d, tokenizer=t),
    "substrings": lambda d, l, b, t: without_repeats(d),
    "quality": lambda d, l, b, t: quality(d, l),
    "toxicity": lambda d, l, b, t: toxicity(d, l),
    "rules": lambda d, l, b, t: quality_rules(d, l),
    "simhash": lambda d, l, b, t: near_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, odd, labels, items, name):
    tokenizer = registry.tokenizer_path()
    got = OPERATORS[name](odd, labels, items, tokenizer)
    assert ids(got) == sorted((r[0] for r in ODD), key=repr)
    empty = OPERATORS[name](odd.limit(0), labels.limit(0), items.limit(0), tokenizer)
    assert empty.columns == got.columns and empty.count() == 0


STAGES = {
    "quality": lambda d, l, b: good_documents(d, l),
    "near copies": lambda d, l, b: without_near_copies(d),
    "decontamination": lambda d, l, b: clean_documents(d, b),
    "mixing": lambda d, l, b: mixed_documents(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(spark, odd, labels, items, name):
    got = STAGES[name](odd, labels, items)
    assert got.columns == odd.columns and got.count() <= 2 * len(ODD)
    assert STAGES[name](odd.limit(0), labels, items).count() == 0


def test_near_copies_leave_one_of_each(spark, odd):
    assert ids(without_near_copies(odd)) == sorted([1, 4, 5, 6, None, 8, 9], key=repr)  # 1, 2 and 3 have no words


def test_pages(spark):
    pages = spark.createDataFrame(WEB, PAGES).withColumn("host", F.lit("x")).withColumn("template", F.lit(1))
    text = {r.page_id: r.text for r in main_text(pages).collect()}
    assert text == {1: "", 2: "", 3: "a\nb", None: "", 5: "<é x y"}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages).collect()}
    assert got[1][:3] == ("", "", None) and got[2][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[3][:3] == ("ex.org", "", None) and got[None] == ("a.com", "/de/1", "com/de/", "block")
    assert main_text(pages.limit(0)).count() == 0 and url_filter(pages.limit(0)).count() == 0


def test_no_leak_without_windows(spark, odd, items):
    assert leaks(odd, items).count() == 0


def test_empty_text_is_its_end_id(spark, odd):
    got = {r.doc_id: r for r in token_index(odd, tokenizer=registry.tokenizer_path()).collect()}
    assert (got[2].n_tokens, got[2].ids_crc32) == (1, zlib.crc32(bytes([2, 0, 0, 0])))


def test_pipeline_runs(spark, sf):
    assert [f for _, f in corpus_pipeline.STAGES][-1] is corpus_pipeline.token_files
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = columns or docs.columns
        assert stage(spark, docs, sf).columns == columns
    assert corpus_pipeline.run(spark, sf).count() > 0
