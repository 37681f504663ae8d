"""Session helpers: worker imports, shared storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it through sys.path alone.

    On a cluster the package is installed or shipped with --py-files; the extra
    path is then simply absent on the executors and has no effect.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests, notebooks in local mode) a
    temporary folder is made and recorded in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cairn.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cairn-')}"
        spark.conf.set("cairn.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"


#: Lets a job drop its shuffle files as it ends; otherwise they lie there until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, mode: str = "error", **options: str) -> None:
    """Write a table, and keep nothing on disk of the job that made it but the table."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path, **options)
    return spark.read.schema(df.schema).parquet(path)


def in_parts(make: Callable[[Column], DataFrame], key: str, parts: int, name: str = "parts") -> DataFrame:
    """make() of the rows that a condition on key lets through, for parts that hold all rows of a key, written one after another and read as one table.

    What the job of a part leaves on disk goes before the next one begins. One part is a plan, and is not written.
    """
    if parts == 1:
        return make(F.lit(True))
    path = None
    for i in range(parts):
        part = make(F.pmod(F.xxhash64(key), F.lit(parts)) == i)
        path = path or new_path(part.sparkSession, name)
        write(part, path, "append", compression="zstd")
    return part.sparkSession.read.schema(part.schema).parquet(path)


#: Bytes of an Arrow batch, where the session sets no bound. A task holds a batch several times, on both sides: Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let batches that go to Python workers end at BATCH_BYTES, so that memory does not follow the length of the texts; a bound that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


#: Partitions of a large table for each that a shuffle has otherwise.
SPREAD = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys together, in more and smaller partitions than a shuffle makes by itself: what one task sorts or holds stays small."""
    return df.repartition(SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete a table written by materialize() that no later plan reads."""
    if isinstance(df_or_path, DataFrame):
        spark, paths = df_or_path.sparkSession, {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
