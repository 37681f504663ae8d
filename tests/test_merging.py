"""Merging with null aliases and rejections, exact names, judging, the vector index and the comparison."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import calls, hooks
from cairn.operators import concepts as C
from cairn.operators import evaluation as V
from cairn.operators import graph as G
from cairn.operators.vector_store import VectorStore
from cairn.sources import json_files as J

CONCEPT = "name string, definition string, chapter string, difficulty int, node_role string, aliases array<string>, ord long"
DECIDED = "p_ord int, name_a string, name_b string, merge boolean, canonical string"


def in_order(rows, decided):
    """The rule, pair by pair: (head, how many, names beside it) of each group."""
    difficulty, aliases, order = {r[0]: r[3] for r in rows}, {r[0]: r[5] or [] for r in rows}, {r[0]: r[6] for r in rows}
    group = {n: [n] for n in difficulty}
    for _, a, b, merge, said in sorted(decided):
        if not merge or group[a] is group[b]:
            continue
        left, right = group[a], group[b]
        worth = lambda n: (bool(C.HAN.search(n)), len(n), difficulty[n] or 1)
        head = said if said in (left[0], right[0]) else right[0] if worth(right[0]) > worth(left[0]) else left[0]
        joint = [head, *[n for n in left + right if n != head]]
        for n in joint:
            group[n] = joint
    out = set()
    for g in {id(g): g for g in group.values()}.values():
        mine = {g[0].lower(), *[x.lower() for x in aliases[g[0]]]}
        more = {x.lower() for n in sorted(g[1:], key=order.get) for x in [n, *aliases[n]]} - mine
        out.add((g[0], len(g), tuple(sorted(x.lower() for x in aliases[g[0]])) + tuple(sorted(more))))
    return out


@pytest.mark.parametrize(("seed", "few"), [(4, 1000), (4, 0), (8, 3)])
def test_decisions_as_pair_by_pair(spark, seed, few):
    rng = random.Random(seed)
    names = [f"{'进' * (i % 4 == 0)}n{'x' * (i % 3)}{i}" for i in range(60)]
    rows = [(n, "d", "c", rng.choice([1, 2, 3]), "概念", rng.choice([None, [], [f"A{i % 7}"], [f"a{i % 7}", f"b{i}"]]), i) for i, n in enumerate(names)]
    decided = [(k, *rng.sample(names[:50], 2), rng.random() < 0.6, rng.choice([None, "", *names[:50]])) for k in range(45)]
    decided = [(k, a, b, m, rng.choice([a, b, s])) for k, a, b, m, s in decided]
    got = C.apply_decisions(spark.createDataFrame(rows, CONCEPT), spark.createDataFrame(decided, DECIDED), few).collect()
    found = set()
    for r in got:
        own = [x.lower() for x in dict((n, a or []) for n, *_, a, _ in rows)[r["name"]]]
        have = [x.lower() for x in r["aliases"] or []]
        assert have[: len(own)] == own
        found.add((r["name"], r["merged"], tuple(sorted(own)) + tuple(sorted(have[len(own) :]))))
    assert found == in_order(rows, decided)


def test_a_name_that_takes_thousands(spark):
    # every second name is first merged with one of its own, then all with one hub
    rows = [(f"n{i:05}", "d", "c", 1, "概念", None, i) for i in range(3000)]
    decided = [(i, f"n{i:05}", f"n{i + 1000:05}", True, f"n{i + 1000:05}") for i in range(1000, 2000)]
    decided += [(10_000 + i, "n00000", f"n{i:05}", True, None) for i in range(1, 2000)]
    rounds = []
    got = C.apply_decisions(spark.createDataFrame(rows, CONCEPT), spark.createDataFrame(decided, DECIDED), 10, rounds).collect()
    assert {(r["name"], r["merged"]) for r in got} == {(x[0], x[1]) for x in in_order(rows, decided)}
    assert rounds == [2999, 1000, 0] and max(r["merged"] for r in got) == 3000


def test_alternating_pairs_end(spark, monkeypatch):
    monkeypatch.setattr(C, "CONTRACTIONS", 2)
    rows = [(f"n{i}", "d", "c", 1 + i % 3, "概念", None, i) for i in range(40)]
    decided = [(2 * i, "n0", f"n{i}", True, f"n{i}") for i in range(1, 20)] + [(2 * i + 1, f"n{i}", f"n{i + 20}", True, None) for i in range(1, 20)]
    rounds = []
    got = C.apply_decisions(spark.createDataFrame(rows, CONCEPT), spark.createDataFrame(decided, DECIDED), 0, rounds).collect()
    assert {(r["name"], r["merged"]) for r in got} == {(x[0], x[1]) for x in in_order(rows, decided)}
    assert len(rounds) == 3 and rounds[-1] > 0


def test_many_small_components_and_a_large_one_settle_in_a_pass(spark):
    # a call a component, and a list rebuilt a pair, took minutes
    n = 20_000
    one, two = F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")
    pairs = spark.range(n).select(F.col("id").cast("int").alias("p_ord"), one.alias("name_a"), two.alias("name_b"), F.lit(True).alias("merge"), two.alias("canonical"))
    hub = spark.range(2 * n).select((n + F.col("id")).cast("int").alias("p_ord"), F.lit("hub").alias("name_a"), F.concat(F.lit("h"), "id").alias("name_b"), F.lit(True).alias("merge"), F.lit(None).cast("string").alias("canonical"))
    decided = pairs.unionByName(hub)
    names = decided.select(F.explode(F.array("name_a", "name_b")).alias("name")).distinct().unionByName(spark.createDataFrame([("alone",)], "name string"))
    c = names.selectExpr("name", "'d' AS definition", "'c' AS chapter", "1 AS difficulty", "'概念' AS node_role", "cast(null AS array<string>) AS aliases", "xxhash64(name) AS ord")
    begun = time.monotonic()
    got = {(r["kind"], r["merged"], r["n"]) for r in C.apply_decisions(c, decided).groupBy(F.substring("name", 1, 1).alias("kind"), "merged").agg(F.count("*").alias("n")).collect()}
    # the longest name stands for the hub's group
    assert got == {("b", 2, n), ("h", 2 * n + 1, 1), ("a", 1, 1)}
    assert time.monotonic() - begun < 120


def test_null_aliases_keep_merged_names(spark):
    c = spark.createDataFrame([("进程", "d", "c", 1, "概念", None, 0), ("proc", "longer", "c", 1, "概念", ["p", None], 1), ("other", "d", "c", 1, "概念", None, 2)], CONCEPT)
    got = {r["name"]: r for r in C.apply_decisions(c, spark.createDataFrame([(1, "进程", "proc", True, None)], DECIDED)).collect()}
    assert got["进程"]["aliases"] == ["proc", "p"] and got["进程"]["definition"] == "longer" and got["other"]["merged"] == 1
    twice = C.dedupe(c.unionByName(c.withColumn("ord", F.col("ord") + 3))).collect()
    assert {(r["name"], tuple(r["aliases"])) for r in twice} == {("进程", ()), ("proc", ("p",)), ("other", ())}


def test_exact_names(spark):
    c = spark.createDataFrame([("a", "", "1", 1, "", ["x"], 1), ("b", "", "2", 1, "", ["x", "a"], 0), ("d", "", None, 1, "", None, 2)], CONCEPT)
    names = spark.createDataFrame([("a",), ("x",), (" x",), ("X",), ("d",), (None,)], "name string")
    assert {(r["name"], r["canonical"]) for r in C.resolve_exact(names, c).collect()} == {("a", "b"), ("x", "b"), (" x", None), ("X", None), ("d", "d"), (None, None)}
    assert C.in_chapters(c, []).count() == 3 and C.in_chapters(c, ["1", "9"]).count() == 1


def test_a_hub_comes_in_pages(spark):
    e = spark.createDataFrame([("h", f"n{i:03}", "RELATED") for i in range(250)] + [("n000", "h", "RELATED"), ("a", "h", "TESTS")], "source string, target string, type string")
    pages = {(r["direction"], r["page"]): r["neighbours"] for r in G.neighbour_pages(e).where("name = 'h'").collect()}
    assert {k: len(v) for k, v in pages.items()} == {("both", 0): 100, ("both", 1): 100, ("both", 2): 50, ("in", 0): 1}
    assert pages[("both", 2)] == [f"n{i:03}" for i in range(200, 250)]


def test_the_vector_index_embeds_what_changed(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def model(texts):
        for t in texts:
            (asked / str(abs(hash(t)))).write_text(t)
        return hooks.hashed_embedding(32)(texts)

    def count():
        n = len(list(asked.iterdir()))
        for f in asked.iterdir():
            f.unlink()
        return n

    rows = [(f"n{i}", f"text number {i}", "c", 1, "概念", [], i) for i in range(12)]
    store = VectorStore(spark, str(tmp_path / "store"), model, 4)
    assert store.update(spark.createDataFrame(rows, CONCEPT)) == 12 and count() == 12
    assert store.update(spark.createDataFrame(rows, CONCEPT)) == 0 and count() == 0
    changed = [(*r[:1], "something else", *r[2:]) if r[0] == "n3" else r for r in rows] + [("new", "fresh words", "c", 1, "概念", [], 12)]
    assert store.update(spark.createDataFrame(changed, CONCEPT)) == 2 and count() == 2
    q = spark.createDataFrame([(1, "概念名称：n3\n定义：something else\n所属章节：c\n节点角色：概念\n难度：1")], "id int, text string")
    hits = VectorStore(spark, str(tmp_path / "store"), model).search(q, 2).orderBy("rank").collect()
    assert (hits[0]["name"], hits[0]["definition"], hits[0]["score"]) == ("n3", "something else", 1.0) and len(hits) == 2


def test_a_comparison_is_resumed(spark, tmp_path):
    rows = [("a", "first thing", "c", 1, "概念", [], 0), ("b", "second thing", "c", 1, "概念", [], 1)]
    c = spark.createDataFrame(rows, CONCEPT)
    e = spark.createDataFrame([("a", "b", "PREREQUISITE", "", 0)], "source string, target string, type string, description string, ord int")
    store = VectorStore(spark, str(tmp_path / "store"), lambda ts: np.array([[float("first" in t), float("second" in t), 0.1] for t in ts]))
    store.update(c)
    asked, log = tmp_path / "n", str(tmp_path / "log")
    asked.mkdir()

    def judge(p):
        (asked / str(abs(hash(p)))).touch()
        if "second" in p.split("【模型回答】")[0] and not (tmp_path / "well").exists():
            raise OSError("down")
        return "[1]" if "[list]" in p else json.dumps({"correct": "[概念部分]" in p or "概念部分" in p, "reason": "r"})

    questions = spark.createDataFrame([(1, "what is first?", "first"), (2, "what is second?", "second"), (3, "neither [list]", "[list]")], "query int, question string, answer string")

    def run():
        out = V.run_comparison(questions, store, c, e, J.terms(c), None, lambda p: p, calls.Asker(judge, log, tries=1))
        return {(r["method"], r["query"]): r for r in out.collect()}

    got = run()
    assert len(got) == 6 and len(list(asked.iterdir())) == 6
    assert got[("graph_rag", 1)]["correct"] is True and got[("vector_rag", 1)]["correct"] is False and got[("vector_rag", 1)]["reason"] == "r"
    assert got[("graph_rag", 2)]["correct"] is None and got[("graph_rag", 2)]["error"] == "OSError: down"
    assert got[("vector_rag", 3)]["correct"] is False and got[("vector_rag", 3)]["reason"] == V.NO_VERDICT
    for f in asked.iterdir():
        f.unlink()
    (tmp_path / "well").touch()
    again = run()
    assert len(list(asked.iterdir())) == 2  # the two that had failed
    assert again[("graph_rag", 2)]["correct"] is True
    details = spark.createDataFrame([(k[0], r["correct"]) for k, r in again.items()], "method string, correct boolean")
    assert {r["method"]: round(r["accuracy"], 3) for r in V.accuracy(details).collect()} == {"graph_rag": 0.667, "vector_rag": 0.0}
    assert [r["query"] for r in V.first_questions(questions.withColumn("ord", -F.col("query")), 2).collect()] == [3, 2]
