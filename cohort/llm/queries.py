"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lines, lm, mixing, neardup, phrases, quality, secrets, spelling, substrings, toxicity, urls, warc
from .common import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql is not None:
        SQL[fn.__name__] = sql
    return fn


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"), quality.trusted_ids(spark, sf_dir))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


SQL["op2_mix_sources"] = mixing.SQL


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents"))


SQL["op7_line_dedup"] = lines.SQL


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


SQL["op8_warc_archives"] = warc.SQL


@query
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


SQL["op5_lm_scores"] = lm.SQL


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(read(spark, sf_dir, "documents"))


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"), urls.train(urls.labelled(spark)))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


SQL["op12_spelling_variants"] = spelling.SQL


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(read(spark, sf_dir, "documents"))


SQL["op11_phrases"] = phrases.SQL
