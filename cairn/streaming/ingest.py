"""Exactly-once intake of a growing folder into a stored collection.

A file stream gives each new file once; each micro-batch is merged into the
collection with its number. A batch that comes again, after a failure between the
merge and the stream's own checkpoint, finds its number in the manifest and
changes nothing. Rows are taken in order of their file's time, their file and
their place in it, so that a stream over many small batches ends where one upsert
of all files ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from cairn.sources.collection import Collection

#: What rows are ordered by within a batch: earlier files first, and rows of a file as they stand.
ORDER = ("_time", "_file", "_lo", "_row")


def placed(df: DataFrame) -> DataFrame:
    """Rows with their place: time and name of their file, the byte range of it, and, where the rows are no stream, the order in the range."""
    at = {"_time": "file_modification_time", "_file": "file_path", "_lo": "file_block_start"}
    out = df.withColumns({k: F.col(f"_metadata.{v}") for k, v in at.items()})
    return out if df.isStreaming else out.withColumn("_row", F.monotonically_increasing_id())


def read_folder(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 1000, kind: str = "json") -> DataFrame:
    """The files of a folder as a stream, about files_a_batch at a time."""
    return placed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind).load(path))


def take_in(stream: DataFrame, into: Collection, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start to merge a stream of read_folder() into a collection; name says which stream it is."""

    def merge(batch: DataFrame, number: int) -> None:
        into.upsert(batch.withColumn("_row", F.monotonically_increasing_id()), list(ORDER), name, number)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
