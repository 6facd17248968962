"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings: UTC so that ISO strings, epochs and casts agree; duplicate
# JSON keys keep the last value; AQE handles coalescing and skewed joins.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

SCRATCH_NAME = re.compile(r".+-[0-9a-f]{32}")


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: a machine-local
    path on a cluster would be lost with the executor that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession, hours: float = 48.0) -> list[str]:
    """Delete intermediate tables of the shared folder that are ``hours`` old; their names.

    A result that was not written yet still reads its tables: allow more hours than any
    job takes.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for found in files.listStatus(folder):
        name = found.getPath().getName()
        age = time.time() * 1000 - found.getModificationTime()
        if SCRATCH_NAME.fullmatch(name) and age >= hours * 3_600_000:
            files.delete(found.getPath(), True)
            gone.append(name)
    return sorted(gone)


def small_side(df: DataFrame, most: int = 10_000, counted: DataFrame | None = None) -> DataFrame:
    """A join side that is broadcast if its counted rows are few, else left to Spark.

    For narrow dimensions and per-topic flags: the large side then never goes through a
    shuffle on a handful of topic keys. ``counted`` is a stored table with a row for each
    of ``df``, which is cheaper to count.
    """
    return F.broadcast(df) if (df if counted is None else counted).limit(most + 1).count() <= most else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a scratch path and read it back, for loops.

    A checkpoint keeps the size that Spark estimated for its plan, and a join estimates the
    product of its sides: a loop over checkpoints multiplies the digits of that number in every
    round, until the driver does nothing else. A stored table has the size of its files.
    """
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
