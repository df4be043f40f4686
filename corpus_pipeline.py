"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns documents with the columns they came with; the last one returns pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, neardup, packing, pii, quality
from keyloom.llm.common import fresh, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier rejects.

    Every row is scored by its whole text, null, empty and repeated ones too; all columns stay, whatever their names. Without
    labels of quality 1 every score is 0.5 and every row is kept. An empty table gives no rows.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("quality", docs)
    return quality.with_score(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that with the least id, and of rows that repeat it the one with the least text.

    Rows without an id are kept; texts without words are linked with nothing; long texts are compared whole. All columns
    stay, whatever their names. An empty table gives no rows.
    """
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; drops documents of which more than half is benchmark.

    Null and empty texts stay as they are, repeated rows are treated alike. All columns stay; n_chars follows the text.
    An empty table gives no rows, and an empty benchmark changes nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data everywhere, and the terms that disclose them wherever they stand.

    All rows and columns stay; n_chars follows the text. Null and empty texts stay as they are, repeated rows are treated
    alike. An empty table gives no rows.
    """
    return pii.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: a row for each piece.

    Null and empty texts are one token; long ones are cut into pieces; repeated rows are packed each. Other columns are
    left out. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_sanitisation),
    ("best_fit_packing", best_fit_packing),
]

#: Learnt scores, shingle classes and tokenizers can't be stated in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
