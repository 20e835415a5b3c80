"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coursecast.llm import fill_middle, merkle, mixing, substrings
from coursecast.llm.decontaminate import leaks
from coursecast.llm.html_text import main_text
from coursecast.llm.packing import packing_index
from coursecast.llm.quality import quality
from coursecast.llm.rules import quality_rules
from coursecast.llm.simhash import near_components
from coursecast.llm.tokens import token_index
from coursecast.llm.toxicity import toxicity
from coursecast.llm.url_filter import url_filter

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        QUERIES[name] = build
        if oracle is not None:
            SQL[name] = oracle
        return build

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op9_quality_rules")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return near_components(table(spark, sf, "documents"))


@query("op2_pareto_mix", mixing.ORACLE)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf, "documents"))


@query("op4_url_filter")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter(table(spark, sf, "pages"))


@query("op1_html_main_text")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_files")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return token_index(table(spark, sf, "documents"), tokenizer=tokenizer_path())


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_substring_dedup", substrings.ORACLE)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf, "documents"))


@query("op11_merkle_manifest", merkle.oracle())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(table(spark, sf, "documents"))


@query("op12_slack_packing")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return packing_index(table(spark, sf, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))


@query("op13_fill_middle", fill_middle.ORACLE)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.fill_middle_index(table(spark, sf, "documents"))
