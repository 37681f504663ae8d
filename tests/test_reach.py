"""The reachability index, the loaded graph, and cycles."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators import reach
from cairn.sources import loaded
from cairn.sources import views as W

PAIRS = "source string, target string"


def bfs(edges, hops):
    up = {}
    for a, b in edges:
        up.setdefault(b, set()).add(a)
    out = set()
    for root in up:
        level, seen = {root}, {root}
        for d in range(1, hops + 1):
            level = {a for x in level for a in up.get(x, ())} - seen
            seen |= level
            out |= {(root, n, d) for n in level}
    return out


@pytest.mark.parametrize("hops", [1, 5])
def test_index_built_and_extended(spark, hops):
    rng = random.Random(hops)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)]  # with cycles, loops and repeats
    first, then = edges[:30], edges[25:]
    index = reach.build(spark.createDataFrame(first, PAIRS), hops)
    assert {tuple(r) for r in index.collect()} == bfs(first, hops)
    more = reach.extend(index, spark.createDataFrame(then, PAIRS), hops)
    assert {tuple(r) for r in more.collect()} == bfs(edges, hops)
    assert reach.extend(more, spark.createDataFrame(edges, PAIRS), hops) is more
    names = spark.createDataFrame([("n1",), ("alone",)], "root string")
    assert {tuple(r) for r in reach.with_selves(more, names).collect()} == {("n1", "n1", 0), ("alone", "alone", 0)} | {x for x in bfs(edges, hops) if x[0] == "n1"}


def test_queries_scan_the_index(spark, sf):
    from cairn.plans.queries import QUERIES

    QUERIES["mastery_by_learner"](spark, sf)
    before = dict(loaded._made)
    for name in ("mastery_by_learner", "plan_nodes", "plan_edges", "trace_aggregate", "learning_path"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") < 25
    assert loaded._made == before  # none was built again


def test_a_changed_file_is_loaded_again(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/part.parquet").limit(20).write.parquet(f"{tmp_path}/part.parquet")
    n = loaded.closure(spark, str(tmp_path)).count()
    spark.read.parquet(f"{sf}/part.parquet").limit(40).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert loaded.closure(spark, str(tmp_path)).count() > n
    assert loaded.closure(spark, str(tmp_path)).exceptAll(G.ancestors(W.concept(spark, str(tmp_path)).select(F.col("name").alias("root")), W.prereq(spark, str(tmp_path)))).count() == 0


def peeled(edges):
    """What stays when nodes without incoming edges are taken away."""
    nodes = {x for e in edges for x in e}
    edges = set(edges)
    while True:
        heads = nodes - {b for _, b in edges}
        if not heads:
            return nodes
        nodes -= heads
        edges = {(a, b) for a, b in edges if a not in heads}


def check_cycle(cycle, edges):
    rows = sorted(cycle.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    assert all((r["source"], r["target"]) in set(edges) for r in rows)
    assert all(a["target"] == b["source"] for a, b in zip(rows, rows[1:] + rows[:1], strict=True))
    assert len({r["source"] for r in rows}) == len(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n, m = rng.choice([(12, 9), (20, 22), (30, 45), (40, 30)])
    edges = [(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range(m)]
    if seed == 0:
        edges = [(a, b) for a, b in edges if a < b]
    g = spark.createDataFrame(edges, PAIRS)
    assert {r["name"] for r in G.cycle_residue(g).collect()} == peeled(edges)
    rows = check_cycle(G.find_cycle(g), edges)
    assert bool(rows) == bool(peeled(edges))


def test_long_chains_take_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select(F.format_string("c%06d", "id").alias("source"), F.format_string("c%06d", F.col("id") + 1).alias("target"))
    rounds = []
    assert G.cycle_residue(chain, rounds).isEmpty() and len(rounds) < 30
    # the chain's end leads back into its middle: what is before the middle is peeled off
    back = chain.unionByName(spark.createDataFrame([(f"c{n:06}", "c050000")], PAIRS))
    rounds = []
    assert G.cycle_residue(back, rounds).count() == n - 50_000 + 1 and len(rounds) < 30
    ring = spark.range(500).select(F.format_string("r%04d", "id").alias("source"), F.format_string("r%04d", (F.col("id") + 1) % 500).alias("target"))
    assert [r["source"] for r in G.find_cycle(ring).orderBy("pos").collect()] == [f"r{i:04}" for i in range(500)]


def test_strong_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "f"), ("g", "a")]
    got = {r["name"]: r["component"] for r in G.strong_components(spark.createDataFrame(edges, PAIRS)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    rng = random.Random(9)
    edges = [(f"v{rng.randrange(30):02}", f"v{rng.randrange(30):02}") for _ in range(50)]
    ahead = {x: {x} for e in edges for x in e}
    for _ in range(30):
        for a, b in edges:
            ahead[a] |= ahead[b]
    want = {x: min(y for y in ahead if y in ahead[x] and x in ahead[y]) for x in ahead}
    assert {r["name"]: r["component"] for r in G.strong_components(spark.createDataFrame(edges, PAIRS)).collect()} == want


def test_names_to_study_in_order(spark):
    from cairn.operators import planning as P

    c = spark.createDataFrame([(n, "d", "c", d, "概念", [], i) for i, (n, d) in enumerate([("a", 1), ("b", 2), ("c", 1), ("z", 1)])], "name string, definition string, chapter string, difficulty int, node_role string, aliases array<string>, ord long")
    pre = spark.createDataFrame([("b", "c"), ("a", "b")], PAIRS)
    tests = spark.createDataFrame([("p1", "a", 0)], "source string, target string, ord int")
    targets = spark.createDataFrame([("l", "c"), ("m", "z"), ("m", "a")], "learner string, name string")
    scores = spark.createDataFrame([("l", "c", 0.2), ("m", "z", 0.1), ("m", "a", 0.9)], "learner string, name string, mastery double")
    got = P.plan_path(targets, scores, c, pre, tests).orderBy("learner", "step").collect()
    assert [(r["learner"], r["concept"]) for r in got] == [("l", "a"), ("l", "b"), ("l", "c"), ("m", "z"), ("m", "a")]
