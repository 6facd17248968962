"""Snapshot table on plain parquet.

A snapshot table is a folder of versions.  A version is a complete keep-latest
table, written beside the one being read; one row in ``commits`` publishes it,
so a reader never sees a half-written version and a rerun of the same version
simply writes it again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "function_name STRING, response_data STRING, cached_at STRING, fetched_at TIMESTAMP"


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def version(self) -> int | None:
        """The published version, or None for a new table."""
        try:
            commits = self.spark.read.schema("version BIGINT").parquet(f"{self.path}/commits")
        except AnalysisException:
            return None
        return commits.agg(F.max("version")).first()[0]

    def read(self, keys: list[str] | None = None) -> DataFrame:
        """All rows, or the named keys with the filter pushed into the scan."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], SCHEMA)
        df = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/version={version}")
        return df if keys is None else df.filter(F.col("function_name").isin(keys))

    def write(self, df: DataFrame, version: int | None = None) -> int:
        if version is None:
            version = (self.version() or 0) + 1
        df.select("function_name", "response_data", "cached_at", "fetched_at").write.mode("overwrite").parquet(
            f"{self.path}/version={version}"
        )
        commit = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
        commit.write.mode("append").parquet(f"{self.path}/commits")
        return version
