"""Intermediate tables in the shared folder, and the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import prepare, scratch_path

# Rows in an Arrow batch: documents may be long, so batches are kept short.
BATCH_ROWS = "512"


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    # Steps end in stored tables, so a step's shuffle files are of no use after it.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_key``: rows are told apart by id and text, so repeated ids stay apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")
    )


def same_row(left: DataFrame, right: DataFrame):
    """Join condition on the row key; a null id equals a null id."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])
