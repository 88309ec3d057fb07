"""The registered queries of this subpackage, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, discriminant, langid, lm, mixing, oracles, quality, search, secrets, shards, simhash, substrings, toxicity, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_language_model": op3_language_model,
    "op4_secrets": op4_secrets,
    "op5_substrings": op5_substrings,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_search": op12_search,
    "op13_discriminant": op13_discriminant,
}

#: The others are held against brute force or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op6_decontamination": oracles.DECONTAMINATION,
    "op7_quality": oracles.QUALITY,
    "op9_mixing": oracles.MIXING,
    "op12_search": oracles.SEARCH,
}
