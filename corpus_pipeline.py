"""The corpus pipeline: raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases: a null or empty text, and one of fewer than eight words, has no votes and is kept or not as the share of good documents says; without an n-gram it is
no near duplicate and has no passage; without a token it is not mixed in and not packed. Null doc_ids and sources are values of their own. Of rows that are repeated as a whole,
and of equal texts, one passes the second stage. Columns beyond those of documents pass through to the packing, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from citeflow.llm import mixing, ngram_join, packing, quality_rules, substring
from citeflow.llm.common import documents, remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return ngram_join.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only where they come first."""
    return substring.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their tempered target weights; a document taken in several epochs is several rows."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("source_mixing", mixture), ("best_fit_packing", sequences)]

#: Expectation-maximisation and best-fit packing are beyond SQL; tests/llm/test_pipeline.py holds every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written to the shared folder, and those of the stage before it are dropped."""
    docs, before = documents(spark, sf_dir), None
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
