"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Texts that are toxic go, then copies, near copies and texts with benchmark passages; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patcheval.functions.stage import staged
from patcheval.llm import decontaminate, exact_dedup, simhash, toxicity
from patcheval.llm.common import table
from patcheval.llm.pieces import encode_and_decode


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of these documents that are not held out, and keeps rows that score below the threshold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles within three bits, as the operator's own query links them."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_decode(docs)


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmarks), ("sentencepiece", encode),
]

#: Neither the scores nor the ids can be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
