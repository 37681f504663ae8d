"""A stored table with a key: rows lie in hash buckets, an upsert rewrites the buckets it touches and no other.

    path/data/<version>/bucket=7/part-….parquet   a bucket's rows as one version has them
    path/manifest/00000003.json                   which version each bucket is read from

A write makes new files beside the old ones and then puts one new manifest in
place; readers take the newest manifest and see a whole write or none of it. Old
versions stay for readers that have begun, until vacuum(). One writer at a time:
a second one that began from the same manifest finds its number taken and fails.

A manifest also holds the last batch of each stream that was taken in, so that a
batch that is given again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import materialize
from cairn.sources.files import path_of
from cairn.sources.frames import keep_first

#: Buckets of a new collection: about as many as its rows fill at a few hundred MB each.
BUCKETS = 64
LAST, FIRST = "last", "first"


class Conflict(RuntimeError):
    """Another writer was faster."""


class Collection:
    """A keyed table at a path. keep: which row of a key stays, the last or the first that came."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str | None = None, key: str = "id", buckets: int = BUCKETS, keep: str = LAST):
        """Open the collection at path, or make an empty one with these properties; those of an existing one stay as they were made."""
        self.spark, self.path = spark, path.rstrip("/")
        fs, folder = path_of(spark, f"{self.path}/manifest")
        self._fs = fs
        if not self._numbers():
            if schema is None:
                raise FileNotFoundError(f"{path}: no collection, and no schema to make one")
            if isinstance(schema, str):
                schema = spark.createDataFrame([], schema).schema
            if keep not in (LAST, FIRST):
                raise ValueError(f"keep: {keep}")
            fs.mkdirs(folder)
            self._put(0, {"key": key, "buckets": buckets, "keep": keep, "schema": json.loads(schema.json()), "files": {}, "streams": {}})

    # manifests -----------------------------------------------------------

    def _numbers(self) -> list[int]:
        fs, folder = path_of(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _name(self, n: int) -> str:
        return f"{self.path}/manifest/{n:08d}.json"

    def _put(self, n: int, manifest: dict) -> None:
        """Write beside and rename: the manifest is there as a whole or not at all."""
        fs, target = path_of(self.spark, self._name(n))
        _, beside = path_of(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(beside, target):
            fs.delete(beside, False)
            raise Conflict(self._name(n))

    def _get(self, n: int) -> dict:
        text = self.spark.read.text(self._name(n), wholetext=True).first()[0]
        return json.loads(text)

    def version(self) -> int:
        return self._numbers()[-1]

    # reading -------------------------------------------------------------

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._get(self.version())["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of an earlier one that is still there."""
        m = self._get(self.version() if version is None else version)
        return self._rows(m, list(m["files"]))

    def _rows(self, m: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{m['files'][b]}/bucket={b}" for b in buckets if b in m["files"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys (a column named as the key): only their buckets are read, where they are fewer than half."""
        m = self._get(self.version())
        asked = keys.select(m["key"]).distinct()
        mine = [str(r[0]) for r in asked.select(self._bucket(m, F.col(m["key"])).alias("b")).distinct().collect()]  # at most a row a bucket
        return self._rows(m, mine if 2 * len(mine) < m["buckets"] else list(m["files"])).join(asked, m["key"], "left_semi")

    @staticmethod
    def _bucket(m: dict, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(m["buckets"])).cast("int")

    # writing -------------------------------------------------------------

    def upsert(self, rows: DataFrame, order: list[str | Column] | None = None, stream: str | None = None, batch: int | None = None) -> bool:
        """Merge rows in; of rows with one key among them the last by `order` (or the first, as the collection keeps) counts.

        Rows lack no column of the collection; others they have are left out. A null
        key is a key. With stream and batch, a batch that is not newer than the
        stream's last one is passed over: the answer says whether rows were taken in.
        """
        n = self.version()
        m = self._get(n)
        if stream is not None and m["streams"].get(stream, -1) >= batch:
            return False
        names = [f["name"] for f in m["schema"]["fields"]]
        given = rows.withColumn("_o", F.struct(*order) if order else F.lit(0)).select(*names, "_o")
        # one row a key: map-side, so that a key with a third of all rows goes as one row a task
        others = [c for c in names if c != m["key"]]
        pick = F.max_by if m["keep"] == LAST else F.min_by
        one = given.groupBy(m["key"]).agg(pick(F.struct(*[F.col(c) for c in others], F.lit(1).alias("_one")), F.struct("_o", *self._tie(others, rows))).alias("r"))
        new = materialize(one.select(m["key"], *[F.col("r").getField(c).alias(c) for c in others]).withColumn("_bucket", self._bucket(m, F.col(m["key"]))), "upsert")
        touched = [str(r[0]) for r in new.select("_bucket").distinct().collect()]  # at most a row a bucket
        files, streams = dict(m["files"]), dict(m["streams"])
        if touched:
            old = self._rows(m, touched).select(*names)
            # an existing row counts as earlier than all that come
            mine = old.withColumn("_src", F.lit(0)).unionByName(new.select(*names).withColumn("_src", F.lit(1)))
            kept = keep_first(mine, [m["key"]], [F.desc("_src") if m["keep"] == LAST else F.col("_src")]).select(*names)
            version = uuid.uuid4().hex
            dealt = kept.withColumn("bucket", self._bucket(m, F.col(m["key"]))).repartition(len(touched), "bucket")
            dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
            files |= dict.fromkeys(touched, version)
        if stream is not None:
            streams[stream] = batch
        self._put(n + 1, m | {"files": files, "streams": streams})
        return True

    @staticmethod
    def _tie(columns: list[str], rows: DataFrame) -> list[Column]:
        """Equal in order: by the rows' own text, so that reruns agree."""
        return [F.to_json(F.struct(*columns))] if columns else []

    def delete(self, keys: DataFrame) -> None:
        """Take the rows of these keys away."""
        n = self.version()
        m = self._get(n)
        gone = materialize(keys.select(m["key"]).distinct().withColumn("_bucket", self._bucket(m, F.col(m["key"]))), "deleted")
        touched = [str(r[0]) for r in gone.select("_bucket").distinct().collect() if str(r[0]) in m["files"]]
        if not touched:
            return
        mark = gone.select(F.col(m["key"]).alias("_gone"))
        kept = materialize(self._rows(m, touched).join(mark, F.col(m["key"]).eqNullSafe(F.col("_gone")), "left_anti"), "kept")
        version = uuid.uuid4().hex
        dealt = kept.withColumn("bucket", self._bucket(m, F.col(m["key"])))
        dealt.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        left = {str(r[0]) for r in dealt.select("bucket").distinct().collect()}
        files = {b: v for b, v in m["files"].items() if b not in touched} | {b: version for b in touched if b in left}
        self._put(n + 1, m | {"files": files})

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete manifests but the newest keep_versions, and bucket files that none of those names. Returns how many bucket folders went."""
        numbers = self._numbers()
        live = set()
        for n in numbers[-keep_versions:]:
            live |= {(v, b) for b, v in self._get(n)["files"].items()}
        gone = 0
        fs, data = path_of(self.spark, f"{self.path}/data")
        for v in fs.listStatus(data) if fs.exists(data) else ():
            for b in fs.listStatus(v.getPath()):
                name = b.getPath().getName()
                if name.startswith("bucket=") and (v.getPath().getName(), name[7:]) not in live:
                    fs.delete(b.getPath(), True)
                    gone += 1
        for n in numbers[:-keep_versions]:
            fs.delete(path_of(self.spark, self._name(n))[1], False)
        return gone
