"""The corpus pipeline: quality rules, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents; what a stage rejects is gone for the later ones.

Defined cases: a document with a null or empty text fails the quality rules; of rows that share
an id and a text one stays, and rows that share an id only are documents of their own; rows
without an id are equal to others by their text only; ties stay with the largest id of equal
texts, and the smallest of near ones; an empty table gives no pieces; columns beside those of
documents go with their rows up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archgraph.llm import exact_dedup, packing, quality, simhash
from archgraph.llm._common import materialize, table
from archgraph.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest calibrated on the labels."""
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    ship(spark)
    return exact_dedup.keep_largest(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    ship(spark)
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("packing", pack_sequences),
]

#: SQL has no isolation forest, XXH64 fingerprints or tokenizer: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
