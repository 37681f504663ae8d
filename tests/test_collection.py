"""The stored collection and the stream into it."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cairn.sources.collection import Collection, Conflict
from cairn.streaming import ingest


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def content(c):
    return {r["id"]: r["v"] for r in c.read().collect()}


def test_an_upsert_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection(spark, path, "id long, v string", buckets=200)
    assert c.read().count() == 0 and c.version() == 0
    rows = spark.range(1000).select("id", F.lit("old").alias("v"), F.lit("x").alias("other"))
    assert c.upsert(rows)
    before = files(path)
    seen = c.read()
    c.upsert(spark.range(0, 1000, 100).select("id", F.lit("new").alias("v")))  # 1 % of the keys
    added = files(path) - before
    assert before <= files(path) and 1 <= len(added) <= 10
    assert content(c) == {i: "new" if i % 100 == 0 else "old" for i in range(1000)}
    assert {r["v"] for r in seen.collect()} == {"old"}  # a reader that began earlier
    assert {r["v"] for r in c.read(1).collect()} == {"old"}
    some = c.get(spark.createDataFrame([(3,), (100,), (5000,)], "id long"))
    assert {(r["id"], r["v"]) for r in some.collect()} == {(3, "old"), (100, "new")}
    assert len(some.inputFiles()) <= 3
    gone = c.vacuum()
    assert gone == len(added) and content(c)[100] == "new" and len(content(c)) == 1000
    again = Collection(spark, path)
    assert again.schema() == c.schema() and again.version() == 2


def test_which_row_of_a_key_stays(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "n", 1), (None, "m", 3), (2, None, 0)], "id int, v string, at int").repartition(3)
    last, first = (Collection(spark, str(tmp_path / k), "id int, v string", keep=k, buckets=4) for k in ("last", "first"))
    for c in (last, first):
        c.upsert(rows, ["at"])
    assert content(last) == {1: "a", None: "m", 2: None} and content(first) == {1: "b", None: "n", 2: None}
    for c in (last, first):
        c.upsert(spark.createDataFrame([(1, "z"), (3, "z")], "id int, v string"))
        c.upsert(rows.limit(0).drop("at"))
    assert content(last) == {1: "z", None: "m", 2: None, 3: "z"} and content(first) == {1: "b", None: "n", 2: None, 3: "z"}
    last.delete(spark.createDataFrame([(1,), (None,), (77,)], "id int"))
    assert content(last) == {2: None, 3: "z"}
    last.delete(spark.createDataFrame([(2,), (3,)], "id int"))
    assert content(last) == {} and last.upsert(rows) and len(content(last)) == 3


def test_no_half_write_and_no_lost_update(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection(spark, path, "id int, v string", buckets=4)
    c.upsert(spark.createDataFrame([(1, "a")], "id int, v string"))
    bad = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string").withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        c.upsert(bad)
    assert content(c) == {1: "a"} and c.version() == 1
    with pytest.raises(Conflict):
        c._put(1, c._get(1))
    with pytest.raises(FileNotFoundError):
        Collection(spark, str(tmp_path / "none"))


def test_a_stream_takes_each_batch_once(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "c")
    folder.mkdir()
    schema = spark.createDataFrame([], "id int, v string").schema
    c = Collection(spark, path, schema, buckets=8)

    def put(name, *rows):
        (folder / name).write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in rows))
        os.utime(folder / name, (time.time() + len(os.listdir(folder)),) * 2)

    def run(check):
        q = ingest.take_in(ingest.read_folder(spark, str(folder), schema, 1), c, "in", str(tmp_path / check))
        q.awaitTermination(120)
        assert q.exception() is None

    put("a.json", (1, "a"), (2, "b"), (1, "c"))
    put("b.json", (2, "d"), (3, "e"))
    run("check")
    assert content(c) == {1: "c", 2: "d", 3: "e"} and c.version() == 2
    put("c.json", (3, "f"))
    run("check")
    assert content(c) == {1: "c", 2: "d", 3: "f"} and c.version() == 3
    # the stream forgets what it has done: its batches are known and change nothing
    c.upsert(spark.createDataFrame([(1, "later")], "id int, v string"))
    run("fresh")
    assert content(c)[1] == "later" and c.version() == 4
    batch = ingest.placed(spark.read.schema(schema).json(str(folder)))
    whole = Collection(spark, str(tmp_path / "whole"), schema, buckets=8)
    whole.upsert(batch, list(ingest.ORDER))
    assert content(whole) == {1: "c", 2: "d", 3: "f"}
