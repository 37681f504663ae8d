"""The whole job in bounded parts."""

import os
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cairn import session
from cairn.operators import concepts as C
from cairn.operators import diagnosis as D
from cairn.operators import planning as P


def test_pairs_of_a_name_in_cells(spark, monkeypatch):
    rows = [(f"c{i:02}", ["Same"] if i % 2 else ["same", "other"], i) for i in range(40)] + [("Other", None, 40), ("alone", ["x"], 41)]
    c = spark.createDataFrame(rows, "name string, aliases array<string>, ord long")
    keys = {n: {x.lower() for x in [n, *(a or [])]} for n, a, _ in rows}
    want = {(a, b, min(keys[a] & keys[b])) for (a, _, _), (b, _, _) in combinations(rows, 2) if keys[a] & keys[b]}
    for cell in (2048, 7):
        monkeypatch.setattr(C, "CELL", cell)
        got = [(r["name_a"], r["name_b"], r["matched_key"]) for r in C.alias_pairs(c).collect()]
        assert len(got) == len(set(got)) == 780 + 20 and set(got) == want


def _graph(spark):
    # a chain of 200 with a second way past every third, and a loop
    ways = [(f"n{i}", f"n{i + 1}") for i in range(199)] + [(f"n{i}", f"n{i + 2}") for i in range(0, 198, 3)] + [("n150", "n148")]
    names = spark.range(200).select(F.concat(F.lit("n"), "id").alias("name"), (1 + F.col("id") % 3).cast("int").alias("difficulty"), F.lit("k").alias("chapter"), F.lit("r").alias("node_role"), F.lit("d").alias("definition"))
    return names, spark.createDataFrame(ways, "source string, target string")


def _plans(spark):
    names, prereq = _graph(spark)
    weak = spark.range(20, 200, 7).select((F.col("id") % 5).alias("learner"), F.concat(F.lit("n"), "id").alias("name"))
    rated = spark.range(0, 200, 2).select((F.col("id") % 5).alias("learner"), F.concat(F.lit("n"), "id").alias("name"), F.element_at(F.array(F.lit("high"), F.lit("low")), (1 + F.col("id") % 4 / 2).cast("int")).alias("risk"), (F.col("id") / 200).alias("mastery"))
    tests = spark.range(200).select(F.concat(F.lit("p"), F.col("id") % 9).alias("source"), F.concat(F.lit("n"), "id").alias("target"), F.col("id").alias("ord"))
    return {
        "nodes": lambda: P.plan_nodes(weak, names, prereq),
        "edges": lambda: P.plan_edges(weak, names, prereq),
        "path": lambda: P.learning_path(weak, rated, names, prereq, tests),
        "unrated": lambda: P.learning_path(weak, None, names, prereq, tests, 1000),
        "traces": lambda: D.trace_problems(tests.select(F.col("source").alias("pid")), D.tested(tests, names), names, prereq),
    }


@pytest.mark.parametrize("name", ["nodes", "edges", "path", "unrated", "traces"])
def test_learners_taken_in_parts(spark, monkeypatch, name):
    make = _plans(spark)[name]
    whole = sorted(map(str, make().collect()))
    written, write = [], session.write
    monkeypatch.setattr(session, "write", lambda df, path, *a, **k: written.append(path) or write(df, path, *a, **k))
    monkeypatch.setattr(D, "PART", 40)
    assert sorted(map(str, make().collect())) == whole and len(whole) > 4
    assert max(map(written.count, written)) >= 3  # a folder that several parts were written to


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}

    before = files()
    t = session.materialize(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count())
    assert not files() - before
    assert t.count() == 700 and spark.conf.get(session.CLEANUP, None) is None


def test_traces_carry_no_column_that_is_not_asked_for(spark):
    names, prereq = _graph(spark)
    tests = spark.createDataFrame([("p1", "n9", 1), ("p1", "n4", 2), ("p2", "n9", 1)], "source string, target string, ord int")
    pids, tested = tests.select(F.col("source").alias("pid")), D.tested(tests, names)
    lean = D.trace_problems(pids, tested, names, prereq, about=())
    full = D.trace_problems(pids, tested, names, prereq)
    assert lean.columns == [c for c in full.columns if c not in D.NODE]
    assert sorted(map(str, lean.collect())) == sorted(map(str, full.drop(*D.NODE).collect()))
    assert "definition" not in lean._jdf.queryExecution().optimizedPlan().toString()


def test_plans_are_ordered_many_at_a_call(spark):
    names, prereq = _graph(spark)
    weak = spark.range(30).select("id", F.concat(F.lit("n"), F.col("id") + 3).alias("name")).withColumnRenamed("id", "learner")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # plans that go on over batches
    try:
        got = P.steps(weak, None, names, prereq, 1000).groupBy("learner").agg(F.count("*").alias("n"), F.max("step").alias("last"), F.count_distinct("name").alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {r["learner"]: r["n"] for r in P.plan_nodes(weak, names, prereq).groupBy("learner").agg(F.count("*").alias("n")).collect()}
    assert {r["learner"]: r["n"] for r in got} == want and all(r["n"] == r["last"] == r["m"] for r in got) and len(want) == 30
