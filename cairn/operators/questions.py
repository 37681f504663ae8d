"""Multi-hop questions from typed paths.

Candidates of each kind are capped in edge order before anything else is built
from them: the caps are part of what is asked for. A cap is a top-k: each task
keeps its own first rows, and only those meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import starts_with_digit
from cairn.operators.graph import induced
from cairn.sources.frames import keep_first

PER_TYPE, MULTIPLIER = 15, 3
P, SV = "PREREQUISITE", "SOLVES"
SEQUENCES = ((P, P, P), (P, P, SV), (P, SV, SV), (SV, SV, SV))


def good_path(path: Column) -> Column:
    """All nodes distinct, none with a digit first."""
    return (F.size(F.array_distinct(path)) == F.size(path)) & ~F.exists(path, starts_with_digit)


def concept_edges(edges: DataFrame, concepts: DataFrame, kind: str) -> DataFrame:
    return induced(edges.where(F.col("type") == kind), concepts.select("name"))


def paths(steps: list[DataFrame]) -> DataFrame:
    """(path, descriptions, o1..on) of walks along one edge table a step that are good paths, the first of each path."""
    n = len(steps)
    named = [s.select(F.col("source").alias(f"n{i}"), F.col("target").alias(f"n{i + 1}"), F.coalesce("description", F.lit("")).alias(f"d{i}"), F.col("ord").alias(f"o{i}")) for i, s in enumerate(steps)]
    walk = reduce(lambda a, ib: a.join(ib[1], f"n{ib[0]}"), list(enumerate(named))[1:], named[0])
    path = F.array(*[F.col(f"n{i}") for i in range(n + 1)])
    rows = walk.select(path.alias("path"), F.array(*[F.col(f"d{i}") for i in range(n)]).alias("descriptions"), *[f"o{i}" for i in range(n)]).where(good_path(F.col("path")))
    return keep_first(rows, ["path"], [f"o{i}" for i in range(n)])


def _node(i: int) -> Column:
    return F.concat(F.lit("「"), F.get("path", i), F.lit("」"))


def _arrows(kinds: tuple[str, ...]) -> Column:
    out = [_node(0)]
    for i, k in enumerate(kinds):
        out += [F.lit(f"-[{k}]->"), _node(i + 1)]
    return F.concat(*out)


def _text(*parts: str | int) -> Column:
    """Fixed texts and nodes, by their place in the path."""
    return F.concat(*[_node(p) if isinstance(p, int) else F.lit(p) for p in parts])


# Fixed texts of questions and answers: they must come out letter by letter.
def question(kinds: tuple[str, ...]) -> Column:
    return {
        (P,): _text("为什么学习", 0, "有助于理解", 1, "？"),
        (SV,): _text("为什么说", 0, "有助于应对", 1, "？"),
        (P, P): _text("为什么理解", 2, "之前需要先学习", 0, "？"),
        (P, SV): _text("为什么学习", 0, "有助于理解", 2, "的解决思路？"),
        (SV, SV): _text("为什么说", 0, "可能间接帮助应对", 2, "？"),
        (P, P, P): _text("为什么说", 0, "是理解", 3, "时可以提前掌握的基础？"),
    }.get(kinds, _text("为什么学习", 0, "有助于分析", 3, "的解决思路？") if len(kinds) == 3 else None)


def answer(kinds: tuple[str, ...]) -> Column:
    because = F.concat(F.lit("图谱依据："), F.array_join("descriptions", "；"))
    if len(kinds) == 1:
        why = _text("这表示", 0, "是理解", 1, "的前置知识。") if kinds == (P,) else _text("这表示", 0, "用于解决或应对", 1, "。")
        return F.concat(F.lit("图谱直接依据是："), _arrows(kinds), F.lit("。"), why, because)
    if kinds == (P, P):
        why = _text("这表示", 0, "是", 1, "的先修，而", 1, "又是", 2, "的先修，所以", 0, "是理解", 2, "的间接前置知识。")
        return F.concat(F.lit("因为图谱中存在二跳先修链："), _arrows(kinds), F.lit("。"), why, because)
    if kinds == (P, SV):
        return F.concat(F.lit("图谱路径是："), _arrows(kinds), F.lit("。"), _text("这表示", 0, "是理解", 1, "的前置知识，而", 1, "用于解决或应对", 2, "。"), because)
    if kinds == (SV, SV):
        return F.concat(F.lit("图谱路径是："), _arrows(kinds), F.lit("。"), _text("因此", 0, "通过", 1, "间接关联到", 2, "这个被解决或应对的对象。"), because)
    if kinds == (P, P, P):
        why = _text("这表示", 0, "支撑", 1, "，", 1, "支撑", 2, "，而", 2, "又支撑", 3, "，所以", 0, "是理解", 3, "的更早期基础。")
    else:
        why = _text("这表示", 0, "先帮助理解后续概念，最终关联到用于解决或应对", 3, "的知识。")
    return F.concat(F.lit("完整图谱路径是："), _arrows(kinds), F.lit("。"), why, because)


def candidates(tables: dict[str, DataFrame], kinds: tuple[str, ...], limit: int) -> DataFrame:
    """The first `limit` questions along paths of these edge types, in edge order."""
    n = len(kinds)
    name = {(P,): "PREREQUISITE_DIRECT", (SV,): "SOLVES_DIRECT"}.get(kinds, "_".join(kinds))
    top = paths([tables[k] for k in kinds]).orderBy(*[f"o{i}" for i in range(n)]).limit(limit)
    order = F.struct(*[F.col(f"o{i}") if i < n else F.lit(None).cast("long").alias(f"o{i}") for i in range(3)])
    return top.select(question(kinds).alias("question"), answer(kinds).alias("answer"), F.lit(n).alias("hops"), "path", F.lit(name).alias("type"), order.alias("o"))


def _group(tables: dict[str, DataFrame], sequences: list[tuple[str, ...]], limit: int) -> DataFrame:
    """Candidates of several sequences, a later one only filling up what the earlier leave."""
    parts = [candidates(tables, s, limit).withColumn("seq", F.lit(i)) for i, s in enumerate(sequences)]
    all_ = keep_first(reduce(DataFrame.unionByName, parts), ["path"], ["seq", "o"])
    return all_.orderBy("seq", "o").limit(limit)


def question_set(edges: DataFrame, concepts: DataFrame, per_type: int = PER_TYPE, multiplier: int = MULTIPLIER) -> DataFrame:
    """One-, two- and three-hop questions, per_type of each of five groups, no two with the same ends.

    A group takes its first questions whose ends no earlier group has taken;
    what a group leaves over does not stand in a later one's way. edges: with a
    long `ord`.
    """
    tables = {k: concept_edges(edges, concepts, k) for k in (P, SV)}
    groups = [[(P,), (SV,)], [(P, P)], [(P, SV)], [(SV, SV)], list(SEQUENCES)]
    chosen = None
    for g, sequences in enumerate(groups):
        c = _group(tables, sequences, per_type * multiplier).withColumns({"a": F.get("path", 0), "b": F.element_at("path", -1), "grp": F.lit(g)})
        c = keep_first(c, ["a", "b"], ["seq", "o"])
        if chosen is not None:
            c = c.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        c = c.orderBy("seq", "o").limit(per_type)
        chosen = c if chosen is None else chosen.unionByName(c)
    return chosen.select("question", "answer", "hops", "path", "type", "grp")
