"""Mixing sources to target weights by min-cost flow.

Documents are counted by membership pattern (the set of sources that may take
them). Words flow from patterns to sources: a pattern's words may be taken once
at no cost, a second and a third time at rising costs, so that the cheapest flow
that fills the sources' quotas repeats as little as it can. The flow network has
one node a pattern and one a source, never one a document. Documents are then
chosen in a seeded order until a pattern's flow is spent.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.text import SPACE_CLASS
from cairn.session import materialize

REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Hash buckets a pattern, at most, and the documents that one is meant to hold: one bucket a pattern is put in order.
BUCKETS, BUCKET_DOCS = 4096, 1000
SEED = 20


def word_count(c):
    return F.coalesce(F.regexp_count(c, F.lit(SPACE_CLASS.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, cap: int = REPEATS, total: float | None = None) -> dict:
    """Share the sum of all sizes by weight; a source stops at cap times its size and the excess is shared again."""
    total = float(sum(sizes.values()) if total is None else total)
    left, open_, out = total, set(sizes), {}
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / w for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
        left = total - sum(out.values())
        open_ -= full
    return out


def min_cost_flow(supply: dict, quota: dict, cap: int = REPEATS) -> dict:
    """Whole words to route from each pattern (a tuple of sources) to each source.

    Shortest augmenting paths on the network source of flow -> pattern (cap arcs
    of its words, at costs 0, 1, 3, ...: convex) -> member sources -> sink.
    """
    nodes: dict = {}
    graph: list[list[list]] = []

    def node(x) -> int:
        if x not in nodes:
            nodes[x] = len(graph)
            graph.append([])
        return nodes[x]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    s, t, through = node("from"), node("to"), []
    for p in sorted(supply, key=repr):
        for k in range(cap):
            arc(s, node(("p", p)), supply[p], k * (k + 1) // 2)
        for src in p:
            through.append((p, src, arc(node(("p", p)), node(("s", src)), cap * supply[p], 0)))
    for src in sorted(quota, key=repr):
        arc(node(("s", src)), t, quota[src], 0)
    height = [0] * len(graph)
    while True:
        dist, came, heap = {s: 0}, {}, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for i, (v, room, cost, _) in enumerate(graph[u]):
                new = d + cost + height[u] - height[v]
                if room > 0 and new < dist.get(v, 1 << 62):
                    dist[v], came[v] = new, (u, i)
                    heapq.heappush(heap, (new, v))
        if t not in dist:
            break
        far = max(dist.values())
        height = [h + dist.get(i, far) for i, h in enumerate(height)]
        v, room = t, 1 << 62
        while v != s:
            u, i = came[v]
            room, v = min(room, graph[u][i][1]), u
        v = t
        while v != s:
            u, i = came[v]
            graph[u][i][1] -= room
            graph[v][graph[u][i][3]][1] += room
            v = u
    return {(p, src): graph[a[0]][a[3]][1] for p, src, a in through}


def _spend(pdf: pd.DataFrame) -> pd.DataFrame:
    """In one hash bucket of a pattern, take what still fits, in the seeded order."""
    pdf = pdf.sort_values(["_order", "_id", "size"], kind="stable", na_position="last")
    left, sizes, took = int(pdf["_left"].iloc[0]), (pdf["size"] * pdf["_same"]).tolist(), []
    for z in sizes:
        took.append(0 < z <= left)
        left -= z * took[-1]
    # one more document, or one for another, if that comes nearer
    z, took = np.array(sizes), np.array(took, bool)
    inside, outside = np.r_[-1, np.flatnonzero(took)], np.flatnonzero(~took & (z > 0))
    if left and len(outside):
        outside = outside[np.argsort(z[outside], kind="stable")]
        want = np.where(inside >= 0, z[inside], 0) + left
        at = np.searchsorted(z[outside], want)
        best = min(((abs(int(want[i] - z[outside[j]])), i, j) for i in range(len(inside)) for j in {max(at[i] - 1, 0), min(at[i], len(outside) - 1)}), default=None)
        if best and best[0] < left:
            took[outside[best[2]]] = True
            if inside[best[1]] >= 0:
                took[inside[best[1]]] = False
    return pdf.assign(_extra=took)[["_id", "_key", "size", "_same", "_extra"]]


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: _id, _key (its pattern), size, _same (rows that repeat it), source_size, target, copies.

    Only one row a source, one row a pattern and one bucket number a pattern come
    to the driver.
    """
    light = materialize(_light(docs, id_col, text_col, source_col).groupBy("_id", "_key", "size").agg(F.first("_members").alias("_members"), F.count("*").alias("_same")), "mix")
    got = light.groupBy("_key").agg(F.first("_members").alias("m"), F.sum(F.col("size") * F.col("_same")).alias("n"), F.count("*").alias("k")).collect()
    supply = {tuple(r["m"]): int(r["n"]) for r in got}
    keys = {tuple(r["m"]): r["_key"] for r in got}
    parts = {tuple(r["m"]): min(BUCKETS, max(1, int(r["k"]) // BUCKET_DOCS)) for r in got}
    size: dict = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = targets(dict(size), {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}, total=sum(supply.values()))
    flow = min_cost_flow(supply, {s: round(g) for s, g in goal.items()})
    plan = []
    for p, n in supply.items():
        taken = sum(flow.get((p, s), 0) for s in p)
        base = min(REPEATS, taken // n) if n else 0
        plan.append((keys[p], base, taken - base * n if base < REPEATS else 0, sum(size[s] for s in p), float(sum(goal[s] for s in p)), parts[p]))
    spark = docs.sparkSession
    # a row a pattern, no more than the flow network had nodes
    schedule = F.broadcast(spark.createDataFrame(plan, "_key string, _base long, _rest long, source_size long, target double, _parts int"))
    placed = light.drop("_members").withColumn("_order", F.xxhash64(F.lit(seed), "_id", "size")).join(schedule.select("_key", "_parts"), "_key")
    placed = placed.withColumn("_bucket", F.pmod("_order", F.col("_parts")).cast("int")).drop("_parts")
    # running sums over at most BUCKETS rows a pattern; the bucket in which the rest runs out is the cut
    per = placed.groupBy("_key", "_bucket").agg(F.sum(F.col("size") * F.col("_same")).alias("n"))
    run = per.withColumn("_upto", F.sum("n").over(Window.partitionBy("_key").orderBy("_bucket"))).join(schedule.select("_key", "_rest"), "_key")
    cut = run.where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("n") <= F.col("_rest"))).select("_key", F.col("_bucket").alias("_cut"), (F.col("_rest") - F.col("_upto") + F.col("n")).alias("_left"))
    cuts = F.broadcast(spark.createDataFrame(cut.collect(), "_key string, _cut int, _left long"))
    dealt = placed.join(schedule, "_key").join(cuts, "_key", "left")
    clear = dealt.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).select("_id", "_key", "size", "_same", F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)).alias("_extra"))
    inside = dealt.where(F.col("_bucket") == F.col("_cut")).select("_id", "_key", "size", "_same", "_order", "_left")
    inside = inside.groupBy("_key").applyInPandas(_spend, "_id long, _key string, size long, _same long, _extra boolean")
    taken = F.when(F.col("size") > 0, F.col("_base") + F.col("_extra").cast("long")).otherwise(F.lit(0).cast("long"))
    return clear.unionByName(inside).join(schedule, "_key").select("_id", "_key", "size", "_same", "source_size", "target", F.least(taken, F.lit(REPEATS)).alias("copies"))


def _light(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    many = dict(docs.dtypes)[source_col].startswith("array")
    members = F.array_sort(F.array_distinct(F.coalesce(F.col(source_col), F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(source_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), members.alias("_members"), word_count(F.col(text_col).cast("string")).alias("size"), *more)
    return rows.withColumn("_key", F.to_json(F.struct(F.col("_members").alias("m"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Mix all documents to their sources' target weights.

    source_col is a string, or an array of strings where sources overlap. Sources
    in code-point order, null last, weigh 1, 2, 3, repeating. Returns id_col, size
    (runs without 0x20 and 0x09-0x0D in the text; null: 0), source_size, target
    (of the document's source; summed where it has several), taken (words,
    repeats counted: 0 to 3 whole copies), one row for each input row. Documents
    without a word are never taken. Rows that repeat an id with the same source
    and size are taken alike. A rerun with the same seed takes the same, however
    the rows are partitioned. An empty table gives an empty one.
    """
    out = copies(docs, id_col, text_col, source_col, seed)
    rows = out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))))
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns."""
    names = docs.columns
    held = _light(docs, id_col, text_col, source_col, F.struct(*[F.col(c) for c in names]).alias("_row")).drop("_members")
    took = copies(docs, id_col, text_col, source_col, seed).where("copies > 0").select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), F.col("size").alias("_size2"), "copies")
    joined = held.join(took, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")) & (F.col("size") == F.col("_size2")))
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
