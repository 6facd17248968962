"""From raw documents to packed sequences: five stages, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import line_dedup, minhash, mixing, packing, quality_mil
from feedloom.llm.storage import ready, stored
from feedloom.sources.tables import read_table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from ``labels``."""
    ready(spark)
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_mil.keep_good(docs, quality_mil.train(docs, labels))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more documents share; the largest doc_id keeps them."""
    ready(spark)
    return line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ready(spark)
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated towards their target shares; copies carry their document's id."""
    return mixing.mix_sources(docs, number="__copy_number").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_shared_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

# Training, tokenisation and component search can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is stored in the shared folder."""
    docs = read_table(ready(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{number}")
    return docs
