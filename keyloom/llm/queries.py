"""One query per training-data operator over its whole table, with production parameters, and oracle SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontam, fingerprints, licenses, neardup, packing, pii, quality, sharding, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_read(spark, sf_dir, "documents"))


QUERIES["op1_merkle_fingerprints"] = op1_merkle_fingerprints
ORACLE["op1_merkle_fingerprints"] = fingerprints.SQL


def op3_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_digest(_read(spark, sf_dir, "documents"))


QUERIES["op3_histogram_sort_shards"] = op3_histogram_sort_shards


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES["op4_decontamination"] = op4_decontamination
ORACLE["op4_decontamination"] = decontam.SQL


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


QUERIES["op7_token_counts"] = op7_token_counts


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op9_best_fit_packing"] = op9_best_fit_packing


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES["op6_pu_quality"] = op6_pu_quality


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_read(spark, sf_dir, "documents"), min_support=1)


QUERIES["op8_pii_disclosure"] = op8_pii_disclosure


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


QUERIES["op5_license_scan"] = op5_license_scan


def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _read(spark, sf_dir, "pages"))


QUERIES["op2_warc_packages"] = op2_warc_packages
ORACLE["op2_warc_packages"] = warc.SQL


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES["op10_near_duplicates"] = op10_near_duplicates
