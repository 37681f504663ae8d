"""The golden example and hand-made adversarial graphs."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import answers as A
from cairn.operators import concepts as C
from cairn.operators import diagnosis as D
from cairn.operators import edges as E
from cairn.operators import graph as G
from cairn.operators import planning as P
from cairn.operators import questions as Q
from cairn.operators import retrieval as R
from cairn.functions import calls, hooks
from cairn.functions import scalar as X
from cairn.sources import json_files as J

EDGE = "source string, target string, type string, description string, ord long"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, "", i) for i, (a, b, t) in enumerate(rows)], EDGE)


@pytest.fixture(scope="module")
def golden(spark):
    names = [("作业", "概念", 1, "3"), ("作业步", "概念", 1, "3"), ("作业流", "概念", 1, "3"), ("内存回收", "机制", 1, "4"), ("首次适应算法", "算法", 2, "4"), ("空闲分区链", "概念", 1, "4"), ("连续分配方式", "概念", 1, "4")]
    concepts = spark.createDataFrame([(n, r, d, c, "", [], i) for i, (n, r, d, c) in enumerate(names)], "name string, node_role string, difficulty int, chapter string, definition string, aliases array<string>, ord long")
    prereq = edges(spark, ("作业", "作业流", "PREREQUISITE"), ("连续分配方式", "空闲分区链", "PREREQUISITE"), ("空闲分区链", "内存回收", "PREREQUISITE"))
    pairs = [("CH3_Q2", "作业"), ("CH3_Q2", "作业步"), ("CH3_Q2", "作业流"), ("CH4_Q5", "空闲分区链"), ("CH4_Q7", "首次适应算法"), ("CH4_Q7", "内存回收"), ("CH4_Q9", "首次适应算法"), ("CH4_Q18", "连续分配方式")]
    tests = edges(spark, *[(a, b, "TESTS") for a, b in pairs])
    attempts = spark.createDataFrame([(1, p, True, False) for p in ("CH3_Q2", "CH4_Q7")], "learner int, pid string, wrong boolean, correct boolean")
    return concepts, prereq, tests, attempts


def test_golden_mastery(golden):
    concepts, prereq, tests, attempts = golden
    got = {r["name"]: r for r in D.mastery_report(attempts, D.tested(tests, concepts), concepts, prereq).collect()}
    want = {"作业": (1.7, 0.0, "high"), "作业步": (1.0, 0.4118, "medium"), "作业流": (1.0, 0.4118, "medium"), "内存回收": (1.0, 0.4118, "medium"), "首次适应算法": (1.0, 0.4118, "medium"), "空闲分区链": (0.7, 0.5882, "medium"), "连续分配方式": (0.5, 0.7059, "low")}
    assert {k: (r["weakness"], r["mastery"], r["risk"]) for k, r in got.items()} == want
    assert got["作业"]["reason"] == "概念「作业」由错题 CH3_Q2 命中，关联考查概念包括「作业、作业流」，weakness=1.7，风险等级为 high。"


def test_golden_aggregate(golden):
    concepts, prereq, tests, attempts = golden
    got = {r["name"]: r for r in D.aggregate(D.trace(attempts, D.tested(tests, concepts), concepts, prereq)).collect()}
    assert got["作业"]["hit_count"] == 2 and len(got) == 7
    assert [tuple(e) for e in got["作业"]["evidences"]] == [("CH3_Q2", "作业", 0), ("CH3_Q2", "作业流", 1)]
    assert got["作业"]["reason"] == "该概念被 2 条错题证据命中，关联考查概念包括「作业、作业流」，建议优先排查。"


def test_golden_path(golden):
    concepts, prereq, tests, attempts = golden
    m = D.mastery(attempts, D.tested(tests, concepts), concepts, prereq)
    path = P.learning_path(P.weak_for_plan(m), m, concepts, prereq, tests).orderBy("step").collect()
    assert [r["concept"] for r in path] == ["作业", "作业步", "作业流", "连续分配方式", "空闲分区链", "内存回收", "首次适应算法"]
    assert path[3]["reason"] == "「连续分配方式」是「空闲分区链」的先修概念，应先补齐基础。 当前风险等级为 low。 估计掌握度为 0.7059。"
    assert path[6]["practice_pids"] == ["CH4_Q7", "CH4_Q9"]


def test_cycle_falls_back(golden, spark):
    concepts, prereq, tests, attempts = golden
    loop = prereq.unionByName(edges(spark, ("作业流", "作业", "PREREQUISITE")))
    weak = spark.createDataFrame([(1, "作业流")], "learner int, name string")
    got = P.learning_path(weak, None, concepts, loop, tests).orderBy("step").collect()
    assert {r["concept"] for r in got} == {"作业", "作业流"} and got[0]["risk"] == "unknown"


def test_cycles(spark):
    assert G.has_no_cycles(edges(spark, ("a", "b", "PREREQUISITE"), ("b", "c", "PREREQUISITE"), ("a", "c", "PREREQUISITE")))
    assert not G.has_no_cycles(edges(spark, ("a", "a", "PREREQUISITE")))
    bad = edges(spark, ("x", "a", "PREREQUISITE"), ("a", "b", "PREREQUISITE"), ("b", "a", "PREREQUISITE"))
    assert {r[0] for r in G.cycle_residue(bad).collect()} == {"a", "b"}


def test_ancestors_shortest(spark):
    e = edges(spark, ("a", "b", "PREREQUISITE"), ("b", "c", "PREREQUISITE"), ("a", "c", "PREREQUISITE"), ("c", "a", "PREREQUISITE"))
    got = {(r["root"], r["node"]): r["depth"] for r in G.ancestors(spark.createDataFrame([("c",)], "root string"), e).collect()}
    assert got == {("c", "c"): 0, ("c", "b"): 1, ("c", "a"): 1}


def test_subgraph(spark):
    concepts = spark.createDataFrame([(n, "d", "c", 1, "概念") for n in "abc"], "name string, definition string, chapter string, difficulty int, node_role string")
    e = edges(spark, ("b", "a", "RELATED"), ("p", "a", "TESTS"), ("p", "c", "TESTS"), ("a", "ghost", "PREREQUISITE"), ("b", "a", "RELATED"))
    seeds = spark.createDataFrame([("q", "a"), ("q", "nowhere")], "root string, node string")
    nodes, found = G.subgraph(seeds, concepts, e, ["RELATED", "TESTS", "PREREQUISITE", "bogus"], 2)
    assert {r["name"] for r in nodes.collect()} == {"a", "b", "c"}
    assert {(r["source"], r["target"], r["type"]) for r in found.collect()} == {("a", "b", "RELATED"), ("p", "a", "TESTS"), ("p", "c", "TESTS"), ("a", "ghost", "PREREQUISITE")}
    nodes, found = G.subgraph(seeds, concepts, e, None, 0)
    assert [r["name"] for r in nodes.collect()] == ["a"] and found.count() == 0


def test_correct_only_learner(golden, spark):
    concepts, prereq, tests, _ = golden
    right = spark.createDataFrame([(7, "CH3_Q2", False, True), (7, "nope", True, False)], "learner int, pid string, wrong boolean, correct boolean")
    got = D.mastery(right, D.tested(tests, concepts), concepts, prereq).collect()
    assert {r["weakness"] for r in got} == {0.0} and {r["mastery"] for r in got} == {1.0}


def test_validate_edges(spark):
    c = spark.createDataFrame([("A", "算法", ["x"], 0), ("B", "概念", [], 1), ("C", "机制", [" B2 "], 2)], "name string, node_role string, aliases array<string>, ord long")
    raw = spark.createDataFrame([(" x ", "B", "SOLVES", "d", 0), ("B", "A", "SOLVES", "", 1), ("A", "x", "RELATED", "", 2), ("Q1", "B2", "TESTS", "", 3), ("Q9", "B", "TESTS", "", 4), ("A", "zz", "RELATED", "", 5), ("B", "C", "PREREQUISITE", "", 6)], EDGE)
    got = E.validate(raw, J.terms(c), c, spark.createDataFrame([("Q1",)], "pid string")).collect()
    assert {(r["source"], r["target"], r["type"]) for r in got} == {("A", "B", "SOLVES"), ("Q1", "C", "TESTS"), ("B", "C", "PREREQUISITE")}
    assert [r["reviewed"] for r in got if r["type"] == "PREREQUISITE"] == [False]


def test_trim_prefers_strong(spark):
    rows = [("s", f"t{i}", "PREREQUISITE", "有助于" if i < 5 else "因为", i) for i in range(12)]
    kept = E.trim_out_degree(spark.createDataFrame(rows, EDGE)).collect()
    assert {r["target"] for r in kept} == {f"t{i}" for i in (0, 1, 2, *range(5, 12))}


@pytest.mark.parametrize("n", [1, 20, 21, 35, 36, 50])
def test_batches(spark, n):
    got = E.chapter_batches(spark.createDataFrame([("c", f"{i:03d}", i) for i in range(n)], "chapter string, name string, ord long")).collect()
    want, start = [], 0
    while True:
        want.append([f"{i:03d}" for i in range(start, min(n, start + 20))])
        if start + 20 >= n:
            break
        start += 15
    assert [[r["name"] for r in sorted(got, key=lambda r: r["pos"]) if r["batch"] == b] for b in range(len(want))] == want


def test_concepts(spark):
    c = spark.createDataFrame([("a", "一", ["z", "b", "y"], 0), ("a", "二", ["x", "a"], 1), ("b", "三", ["q"], 2), ("", "四", [], 3)], "name string, definition string, aliases array<string>, ord long")
    got = {r["name"]: r["aliases"] for r in C.dedupe(c).collect()}
    assert got == {"a": ["x", "y", "z"], "b": ["q"]}
    t = {r["term"]: r["canonical"] for r in J.terms(c.where("name <> ''")).collect()}
    assert t["b"] == "b" and t["z"] == "a"


def test_components_of_chains_and_tangles(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(60 - i, 61 - i) for i in range(15)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(160)]
    order = list(range(400))
    rng.shuffle(order)
    links = [(order[a], order[b]) for a, b in links]
    smallest = list(range(400))
    for _ in range(400):
        for a, b in links:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    got = C.components(spark.range(400), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == dict(enumerate(smallest))


def test_merge_is_transitive(spark):
    c = spark.createDataFrame([("A", "d", "c", 1, "概念", ["a"], 0), ("进程", "longer text", "c", 1, "概念", [], 1), ("proc", "x", "c", 2, "概念", ["p"], 2), ("other", "o", "c", 1, "概念", [], 3)], "name string, definition string, chapter string, difficulty int, node_role string, aliases array<string>, ord long")
    d = spark.createDataFrame([(1, "A", "进程", True, None), (2, "proc", "A", True, "bogus"), (3, "other", "A", False, None)], "p_ord int, name_a string, name_b string, merge boolean, canonical string")
    got = {r["name"]: r for r in C.apply_decisions(c, d).collect()}
    # "a" is "A" once folded: the first of the two stays
    assert set(got) == {"进程", "other"} and got["进程"]["merged"] == 3 and got["进程"]["aliases"] == ["A", "proc", "p"]
    assert got["进程"]["definition"] == "longer text" and got["other"]["merged"] == 1


def test_merge_chooses_names_in_decision_order(spark):
    c = spark.createDataFrame([("ab", "one", "c", 1, "概念", ["x", "X"], 0), ("abc", "four", "c", 1, "概念", ["x", "y"], 1), ("de", "five!", "d", 3, "概念", [" Y ", "z"], 2), ("fg", "", "c", 3, "算法", [], 3)], "name string, definition string, chapter string, difficulty int, node_role string, aliases array<string>, ord long")
    # the longer name is kept; then the proposed one, as it still stands; the last proposal is of a name that is gone
    d = spark.createDataFrame([(1, "ab", "abc", True, ""), (2, "ab", "de", True, "de"), (3, "abc", "fg", True, "ab")], "p_ord int, name_a string, name_b string, merge boolean, canonical string")
    (r,) = C.apply_decisions(c, d).collect()
    # de and fg are alike in length and difficulty: the first of the pair
    assert (r["name"], r["definition"], r["chapter"], r["merged"]) == ("de", "five!", "d", 4)
    assert r["aliases"] == [" Y ", "z", "ab", "x", "abc", "fg"]


def test_review_batches_are_numbered_over_all_pairs(spark):
    pairs = spark.createDataFrame([(i, i + 1, "embedding" if i % 3 else "alias_match", (i * 7 % 50) / 50) for i in range(100)], "idx_a int, idx_b int, source string, confidence double").repartition(7)
    got = C.review_batches(pairs, 15).orderBy("p_ord").collect()
    want = sorted(range(100), key=lambda i: (i % 3 != 0, -(i * 7 % 50), i))
    assert [r["idx_a"] for r in got] == want and [(r["p_ord"], r["batch"]) for r in got] == [(i + 1, i // 15) for i in range(100)]


def test_text_functions(spark):
    one = spark.range(1)
    page = one.select(X.clean_page(F.lit("·12·\ntext 1\n\n 3 \n1234567\n")).alias("t")).first()["t"]
    assert page == "text 1\n\n1234567\n"
    got = one.select(X.chunks(F.lit("aaaa\n\nbbbb\n\n\n cc \n\n" + "d" * 20), 10).alias("c")).first()["c"]
    assert got == ["aaaa\n\nbbbb", "cc", "d" * 20]
    assert one.select(X.chapter_heading(F.lit("第三章 处理机 调度")).alias("h")).first()["h"].asDict() == {"number": 3, "title": "处理机调度"}
    assert one.select(X.chapter_heading(F.lit("第十一章 x")).alias("h")).first()["h"] is None
    assert one.select(X.parse_csv(F.lit("a， b,,c ")).alias("c")).first()["c"] == ["a", "b", "c"]
    assert one.select(X.truncate(F.lit("abcdef"), 3).alias("c")).first()["c"] == "abc…"
    assert one.select(X.format_accuracy(F.lit(0.5)).alias("a"), X.format_accuracy(F.lit(None).cast("double")).alias("b")).first() == ("50.00%", "N/A")


def test_retrieval(spark):
    chunks = spark.createDataFrame([("c1", "a b a"), ("c2", "b"), ("c3", None)], "chunk_id string, text string")
    terms = spark.createDataFrame([("a", "A"), ("b", "B")], "term string, canonical string")
    asked = spark.createDataFrame([("q", "A"), ("q", "B")], "query string, canonical string")
    got = R.chunks_by_concepts(asked, chunks, terms).orderBy("rank").collect()
    assert [(r["chunk_id"], r["hit_count"]) for r in got] == [("c1", 2), ("c2", 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)], "id int, vec array<float>")
    top = R.top_k(v.where("id = 1"), v, 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in top] == [(1, 1.0), (3, round(1 / (2 - 2**-0.5), 6))]
    assert {(r["a"], r["b"]) for r in R.similar_pairs(v, 0.7, 2).collect()} == {(1, 3), (2, 3)}


def test_questions(spark):
    concepts = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "1x"]], "name string")
    e = edges(spark, ("a", "b", "PREREQUISITE"), ("b", "c", "PREREQUISITE"), ("c", "d", "SOLVES"), ("b", "a", "PREREQUISITE"), ("a", "1x", "PREREQUISITE"))
    got = Q.question_set(e, concepts).collect()
    assert {tuple(r["path"]) for r in got} == {("a", "b"), ("b", "c"), ("b", "a"), ("c", "d"), ("a", "b", "c"), ("b", "c", "d"), ("a", "b", "c", "d")}
    assert next(r["question"] for r in got if tuple(r["path"]) == ("a", "b", "c")) == "为什么理解「c」之前需要先学习「a」？"


def test_hooks(spark):
    prompts = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, prompt string")

    def client(p):
        if p == "bad":
            raise ValueError("no")
        return '```json\n{"x": 3}\n```'

    got = {r["id"]: r for r in hooks.complete_json(prompts, client, "x int", pause=lambda k: 0.0).collect()}
    assert got[1]["parsed"]["x"] == 3 and got[2]["error"] == "ValueError: no" and got[3]["value"] is None
    vecs = hooks.embed(spark.createDataFrame([(1, "abc"), (2, "abc")], "id int, text string"), hooks.hashed_embedding(8)).collect()
    assert vecs[0]["vec"] == vecs[1]["vec"]


def test_json_round_trip(spark, tmp_path):
    p = str(tmp_path / "c.json")
    with open(p, "w") as f:
        f.write('[{"name": "b", "difficulty": 2}, {"name": "a"}]')
    got = J.with_defaults(J.read_concepts(spark, p)).orderBy("ord").collect()
    assert [(r["name"], r["difficulty"], r["node_role"]) for r in got] == [("b", 2, "概念"), ("a", 1, "概念")]
    assert J.read_chunks(spark, str(tmp_path / "none.json")).count() == 0
    old = spark.createDataFrame([("k", 1, 0)], "key string, v int, ord long")
    new = spark.createDataFrame([("k", 2, 0), ("m", 3, 1)], "key string, v int, ord long")
    assert {(r["key"], r["v"]) for r in J.upsert(old, new, "key").collect()} == {("k", 2), ("m", 3)}
    assert {(r["key"], r["v"]) for r in J.merge_incremental(old, new, ["key"]).collect()} == {("k", 1), ("m", 3)}


def test_streaming_activity(spark, sf, tmp_path):
    import shutil

    from cairn.streaming.activity import activity, read_events

    shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet")
    schema = spark.read.parquet(str(tmp_path / "events.parquet")).schema
    q = activity(read_events(spark, str(tmp_path), schema)).writeStream.outputMode("complete").format("memory").queryName("act").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("act").agg(F.sum("n")).first()[0] == 1000


def _concepts(spark, *rows):
    return spark.createDataFrame([(n, d, "c", 1, "概念", a, i) for i, (n, d, a) in enumerate(rows)], "name string, definition string, chapter string, difficulty int, node_role string, aliases array<string>, ord long")


def test_answers(spark):
    c = _concepts(spark, ("a", "first", ["A"]), ("b", "second", []), ("z", "far", []))
    e = edges(spark, ("a", "b", "PREREQUISITE"))
    asked = spark.createDataFrame([(1, "why a?"), (2, "nothing"), (3, "who?")], "query int, question string")
    seeds = spark.createDataFrame([(1, 1, "a"), (3, 1, "no node")], "query int, rank int, name string")
    chunks = spark.createDataFrame([("k1", "c1", "b and A"), ("k2", None, "z")], "chunk_id string, chapter string, text string")
    got = {r["query"]: r for r in A.graph_answers(asked, seeds, c, e, J.terms(c), chunks, lambda p: p).collect()}
    assert "why a?" in got[1]["answer"] and "- a -[PREREQUISITE]-> b：" in got[1]["answer"]
    assert got[1]["answer"].endswith("片段 1（来源：c1；涉及概念：a、b）\nb and A")
    assert got[2]["answer"] == A.NO_SEEDS and got[3]["answer"].endswith(A.NO_CHUNKS)
    assert "原文片段】" not in {r["query"]: r for r in A.graph_answers(asked, seeds, c, e, J.terms(c), None, lambda p: p).collect()}[1]["answer"]
    hits = spark.createDataFrame([(1, 1, "a", "first"), (1, 2, "b", None)], "query int, rank int, name string, definition string")
    said = {r["query"]: r["answer"] for r in A.vector_answers(asked, hits, lambda p: p).collect()}
    assert said[1].endswith("- 名称：a；定义：first\n- 名称：b；定义：") and set(said) == {1, 2, 3}


def test_candidates_are_validated_in_batches(spark):
    c = _concepts(spark, *[(f"n{i}", "d" * 200, []) for i in range(25)])
    pairs = spark.createDataFrame([(f"n{i}", "n24", "t" * 300, i) for i in range(23)], "source string, target string, definition string, ord long")

    def client(prompt):
        import json
        import re

        assert "t" * 101 not in prompt and "d" * 51 not in prompt
        names = re.findall(r"A=(\w+)", prompt)
        assert len(names) <= 10
        if "n10" in names:
            raise ValueError("this batch is lost")
        return "```json\n" + json.dumps({"results": [{"is_prerequisite": int(n[1:]) % 2 == 0, "description": f" {n} "} for n in names[:-1]]}) + "\n```"

    got = {(r["source"], r["description"]) for r in E.validate_candidates(pairs, c, calls.Asker(client, tries=1)).collect()}
    # the second batch fails, and the last pair of each other one has no answer
    assert got == {(f"n{i}", f"n{i}") for i in (0, 2, 4, 6, 8, 20)}


def test_confusable(spark):
    c = _concepts(spark, ("a", "first", []), ("b", "second", []))
    rows = [("a", "b", 0.9, (False,)), ("a", "gone", 0.95, (False,)), ("b", "a", 0.8, (False,)), ("b", "b", 0.99, (True,)), ("a", "a", 0.99, None)]
    report = spark.createDataFrame(rows, "name_a string, name_b string, confidence double, decision struct<merge boolean>")
    got = E.confusable(report, c, lambda p: '{"confusable": true, "dimensions": "x"}').collect()
    assert [tuple(r) for r in got] == [("a", "b", "CONFUSABLE", "x", "")]


def test_normalize(spark):
    c = _concepts(spark, ("p", "one", ["q"]), ("Q", "longer", []), ("r", "three", []), ("s", "four", []))
    embed = spark.createDataFrame([(0, 1, "p", "Q", 0.9), (2, 3, "r", "s", 0.85)], "idx_a long, idx_b long, name_a string, name_b string, confidence double")

    def client(prompt):
        import json

        return json.dumps([{"merge": x["name_a"] == "p", "canonical": "p"} for x in json.loads(prompt)])

    merged, report, counts = C.normalize(c, embed, client)
    # "Q" is "q" in another case, which the base has already
    assert {(r["name"], r["definition"], tuple(r["aliases"])) for r in merged.collect()} == {("p", "longer", ("q",)), ("r", "three", ()), ("s", "four", ())}
    assert [(r["name_a"], r["source"], r["decision"]["merge"]) for r in report.orderBy("p_ord").collect()] == [("p", "alias_match", True), ("r", "embedding", False)]
    assert counts.first().asDict() == {"input": 4, "output": 3, "candidates": 2, "alias": 1, "embedding": 1, "approved": 1, "rejected": 1}
    same, _, none = C.normalize(c.where("name in ('r', 's')"), None, client)
    assert same.count() == 2 and none.first()["candidates"] == 0


def test_render_and_lookup(spark):
    e = edges(spark, ("b", "a", "RELATED"), ("a", "b", "RELATED"), ("a", "b", "PREREQUISITE"), ("x", "a", "TESTS"), ("a", "c", "RELATED"), ("a", "b", "OTHER"))
    shown = spark.createDataFrame([("a",), ("b",), ("x",)], "name string")
    assert {(r["source"], r["target"], r["type"]) for r in G.render_edges(e, shown, True).collect()} == {("b", "a", "RELATED"), ("a", "b", "PREREQUISITE"), ("x", "a", "TESTS")}
    assert G.render_edges(e, shown, False).count() == 2
    problems = spark.createDataFrame([("1", "first", 0), ("1", "second", 1)], "pid string, stem string, ord long")
    asked = spark.createDataFrame([("1",), ("1",), ("2",)], "pid string")
    assert {(r["pid"], r["stem"]) for r in D.problems_by_pid(asked, problems).collect()} == {("1", "first"), ("2", None)}
    got = spark.range(1).select(X.split_exercises(F.lit("𝒳 text\n习 题\n1. 习题")).alias("x"), X.split_exercises(F.lit(None).cast("string")).alias("n")).first()
    assert tuple(got["x"]) == ("𝒳 text", "\n习 题\n1. 习题") and tuple(got["n"]) == (None, "")


def test_orders_and_flat_reports(spark):
    from pyspark.sql import types as T

    from cairn.operators import evaluation as V
    from cairn.session import materialize, release

    c = spark.createDataFrame([("l", "b", 1, 1, "c"), ("l", "a", 1, 1, "c"), ("l", "z", 0, 3, "c"), ("k", "y", 2, 1, "c")], "learner string, name string, depth int, difficulty int, chapter string")
    assert [r["name"] for r in D.sort_candidates(c).collect()] == ["y", "z", "a", "b"]
    m = spark.createDataFrame([("l", "a", "low", 0.1, 0.9), ("l", "b", "high", 1.0, 0.1), ("l", "c", "high", 1.5, 0.2), ("l", "d", "medium", 0.5, 0.5)], "learner string, name string, risk string, weakness double, mastery double")
    assert [r["name"] for r in D.sort_mastery(m).collect()] == ["c", "b", "d", "a"]
    one = T.StructType([T.StructField("details", T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("correct", T.BooleanType())])))])
    report = spark.createDataFrame([(([("q1", True), ("q2", False)],), ([("q1", False)],))], T.StructType([T.StructField("a", one), T.StructField("b", one)]))
    assert sorted(tuple(r) for r in V.flatten_details(report, ["a", "b"]).collect()) == [("a", "q1", True), ("a", "q2", False), ("b", "q1", False)]
    written = materialize(m)
    files = written.inputFiles()
    release(written)
    from pathlib import Path

    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)
