"""From raw documents to token ids: five stages, each an operator of ``quillstone.llm``.

Every stage works on all rows that the one before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import mixing, pieces, pii, quality, simhash
from quillstone.runtime import ensure_checkpoint_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles have a similarity of 0.8 or more, the document
    of the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks of its kind; lengths follow."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of their source take them."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return pieces.encode(docs, pieces.read_model(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Fingerprints' groups, a trained tagger and a tokenizer are beyond SQL; tests hold ``run``
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written as Parquet and read again.

    Texts of any length are taken whole. Rows that share an id but not the text are documents of
    their own; repeated rows are copies, of which one stays. Null texts go with the quality rules.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
