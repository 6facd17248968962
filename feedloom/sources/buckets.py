"""Snapshot table in hash buckets: a change rewrites only the buckets it touches.

A version is a small manifest: the folder of each bucket, and each writer's last
batch. Publishing it creates a file that must not exist yet, so of several writers
one wins and the others go on from its version. A batch that is in the manifest
already changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.snapshots import upsert
from feedloom.sources.snapshots import SCHEMA

COLUMNS = ("function_name", "response_data", "cached_at", "fetched_at")


class Folder:
    """The few file operations of a commit, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """Write a new small file; False if there is one of that name."""
        path = self._path(name)
        try:
            out = self.fs.create(path, False)
        except Exception:  # noqa: BLE001 - whatever Java says: is it there now?
            if self.fs.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def age_hours(self, name: str) -> float:
        return (time.time() * 1000 - self.fs.getFileStatus(self._path(name)).getModificationTime()) / 3_600_000

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Manifest:
    version: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"folders": self.folders, "batches": self.batches}) + "\n"

    @classmethod
    def of(cls, version: int, text: str) -> Manifest | None:
        if not text.endswith("\n"):
            return None  # its writer died, or is not done yet: it was never published
        found = json.loads(text)
        return cls(version, {int(b): f for b, f in found["folders"].items()}, found["batches"])


class BucketTable:
    """Keep-latest snapshots by ``function_name``; ``buckets`` is fixed for the life of a table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.files = Folder(spark, path)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int | None = None) -> Manifest:
        """The published state, the newest one unless a version is named."""
        names = [f"{version:012d}"] if version is not None else reversed(self.files.names("versions"))
        for name in names:
            found = Manifest.of(int(name), self.files.read(f"versions/{name}"))
            if found is not None:
                return found
        return Manifest()

    def read(self, keys: list[str] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of the named keys from their buckets only."""
        manifest = self.manifest(version)
        if keys is None:
            return self._rows(manifest, set(manifest.folders))
        wanted = self.spark.createDataFrame([(k,) for k in keys], "k STRING").select(self.bucket(F.col("k")).alias("b")).distinct()
        return self._rows(manifest, {r["b"] for r in wanted.collect()}).filter(F.col("function_name").isin(keys))

    def _rows(self, manifest: Manifest, buckets: set[int]) -> DataFrame:
        paths = [f"{self.path}/data/{manifest.folders[b]}/bucket={b}" for b in sorted(buckets) if b in manifest.folders]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, changes: DataFrame, writer: str = "", batch_id: int | None = None) -> int:
        """Insert or replace rows; the published version that holds them."""
        return self._change(changes.select(*COLUMNS), upsert, writer, batch_id)

    def delete(self, keys: DataFrame, writer: str = "", batch_id: int | None = None) -> int:
        """Remove the rows of the named keys."""

        def without(old: DataFrame, gone: DataFrame) -> DataFrame:
            return old.join(gone.select("function_name"), "function_name", "left_anti")

        return self._change(keys.select("function_name"), without, writer, batch_id)

    def _change(self, rows: DataFrame, merge: Callable, writer: str, batch_id: int | None) -> int:
        def done(manifest: Manifest) -> bool:
            return batch_id is not None and manifest.batches.get(writer, -1) >= batch_id

        base = self.manifest()
        if done(base):
            return base.version
        # Written once, however often the merge must be repeated; its folders name the touched buckets.
        staged = f"staged/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket(F.col("function_name"))).write.partitionBy("bucket").parquet(f"{self.path}/{staged}")
        touched = {int(n.split("=")[1]) for n in self.files.names(staged) if n.startswith("bucket=")}
        change = self.spark.read.parquet(f"{self.path}/{staged}").select(*rows.columns) if touched else rows.limit(0)
        folder = merged = None
        while not done(base):
            # Only another writer's change to the same buckets asks for another merge.
            seen = {b: base.folders.get(b) for b in touched}
            if folder is None or merged != seen:
                folder, merged = uuid.uuid4().hex, seen
                left = merge(self._rows(base, touched), change).withColumn("bucket", self.bucket(F.col("function_name")))
                left.select(*COLUMNS, "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
                full = {int(n.split("=")[1]) for n in self.files.names(f"data/{folder}") if n.startswith("bucket=")}
            folders = {b: f for b, f in base.folders.items() if b not in touched} | {b: folder for b in full}
            batches = base.batches if batch_id is None else {**base.batches, writer: batch_id}
            after = Manifest(self._next_version(), folders, batches)
            if self.manifest().version == base.version and self.files.create(f"versions/{after.version:012d}", after.text()):
                base = after
                break
            base = self.manifest()
        self.files.delete(staged)
        return base.version

    def _next_version(self) -> int:
        names = self.files.names("versions")
        return int(names[-1]) + 1 if names else 1

    def expire(self, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Delete folders that the newest ``keep`` versions don't name and that are ``hours`` old.

        A reader holds its version as long; so does a writer that has not committed yet.
        """
        names = self.files.names("versions")
        newest = [self.manifest(int(n)) for n in names[-keep:]]
        used = {f for m in newest for f in m.folders.values()}
        gone = [f for f in self.files.names("data") if f not in used and self.files.age_hours(f"data/{f}") >= hours]
        for folder in gone:
            self.files.delete(f"data/{folder}")
        for name in names[:-keep]:
            if self.files.age_hours(f"versions/{name}") >= hours:
                self.files.delete(f"versions/{name}")
        return gone
