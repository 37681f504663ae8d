"""Concurrent model calls, their log, and the extractors and drivers over them."""

import json
import re
import threading
import time

from pyspark.sql import functions as F

from cairn.functions import calls
from cairn.operators import extraction as X


def test_calls_overlap_and_results_keep_their_order():
    running, most, lock = 0, 0, threading.Lock()

    def client(p):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.2 if int(p) % 10 == 0 else 0.01)
        with lock:
            running -= 1
        return p

    began = time.time()
    got = list(calls.pooled(iter([str(i) for i in range(80)]), client))
    assert got == [(str(i), None) for i in range(80)]
    assert 8 <= most <= 16 and time.time() - began < 1.2  # one after another it takes 2.3 seconds


def test_a_failing_call_does_not_hold_the_others():
    tried, ended = {}, []

    def client(p):
        tried[p] = tried.get(p, 0) + 1
        if p == "bad" or (p == "late" and tried[p] < 3):
            raise ValueError("no")
        ended.append(p)
        return p.upper()

    got = list(calls.pooled(iter(["bad", "late", None, *"abcdefgh"]), client, in_flight=1, pause=lambda k: 0.1))
    assert got == [(None, "ValueError: no"), ("LATE", None), (None, "no prompt"), *[(c.upper(), None) for c in "abcdefgh"]]
    assert tried["bad"] == 3 and tried["late"] == 3 and ended[-1] == "late"


def test_waiting_prompts_are_bounded():
    read = 0

    def prompts():
        nonlocal read
        for i in range(500):
            read = i + 1
            yield str(i)

    for n, _ in enumerate(calls.pooled(prompts(), lambda p: p, waiting=20)):
        assert read <= n + 21
    assert list(calls.pooled(iter([]), lambda p: p)) == []
    assert list(calls.pooled(iter(["x"]), lambda p: 3, tries=1))[0][1].startswith("TypeError")


def test_short_calls_need_no_wait_each():
    n, begun = 50_000, time.monotonic()
    assert sum(v == "a" for v, _ in calls.pooled(iter(["a"] * n), lambda p: p)) == n
    assert time.monotonic() - begun < 1.5


def test_prompts_of_a_stream_that_is_left_are_not_asked():
    asked = []
    stream = calls.pooled(iter(map(str, range(200))), lambda p: (asked.append(p), time.sleep(0.01), p)[-1], in_flight=2)
    assert next(stream) == ("0", None)
    stream.close()
    time.sleep(0.1)
    assert len(asked) < 20


def test_a_log_is_paid_for_once(spark, tmp_path):
    log, seen = str(tmp_path / "log"), str(tmp_path / "seen")

    def client(p):
        with open(f"{seen}-{hash(p)}-{time.time_ns()}", "w") as f:
            f.write(p)
        if p == "p7":
            raise ValueError("later")
        return p + "!"

    def asked():
        import glob

        return sorted(open(f).read() for f in glob.glob(f"{seen}-*"))

    rows = [(i, f"p{i % 10}") for i in range(20)] + [(99, None)]
    prompts = spark.createDataFrame(rows, "id int, prompt string").repartition(3)
    one = calls.Asker(client, log, model="m", tries=1, task_prompts=2, wave_prompts=4)
    got = {r["id"]: (r["value"], r["error"]) for r in one(prompts).collect()}
    assert got == {i: (None, "ValueError: later") if p == "p7" else (None, "no prompt") if p is None else (p + "!", None) for i, p in rows}
    assert asked() == [f"p{i}" for i in range(10)]
    # a second run asks for what is new and what failed
    more = spark.createDataFrame([(1, "p1"), (2, "p7"), (3, "new")], "id int, prompt string")
    assert {r["value"] for r in one(more).collect()} == {"p1!", None, "new!"}
    assert asked() == sorted([f"p{i}" for i in range(10)] + ["p7", "new"])
    assert one(prompts.limit(0)).count() == 0


PAGES = [
    ("book", 10, "第一章 进程\n进程是资源分配的单位。\n\n线程是调度的单位，100% 属于进程。\n习题\n1. 什么是进程？\n2. 比较进程和线程。"),
    ("book", 11, "第二章 内存\n分页把内存分成页，页由进程使用。"),
]
CONCEPTS = {
    "进程": ("进程", "资源分配的基本单位", "概念", ["process"]),
    "线程": ("线程", "CPU 调度的基本单位，属于进程", "机制", ["thread", "进程"]),
    "分页": ("分页", "把内存分成固定大小的页", "机制", []),
    "内存": ("内存", "存放程序和数据的部件", "问题", []),
}


def model(prompt):
    """Answers every kind of prompt by fixed rules; one chunk's call is lost."""
    head, _, body = prompt.partition("\n")
    if '"concepts"' in head:
        said = [dict(zip(("name", "definition", "node_role", "aliases"), c, strict=True), difficulty="2" if n == "线程" else 1) for n, c in CONCEPTS.items() if n in body]
        return json.dumps({"concepts": [*said, {"name": "x", "definition": "短"}]}, ensure_ascii=False)
    if '"problems"' in head:
        prefix = re.search(r"从 (\w+)_Q1", head)[1]
        return json.dumps({"problems": [{"pid": f"{prefix}_Q{i}", "stem": s, "type": "记忆", "chapter": "c"} for i, s in enumerate(re.findall(r"\d\. (.+)", body), 1)] + [{"pid": "none", "stem": " "}]})
    if '"chapter_deps"' in head:
        chapters = re.findall("【(.+?)】", body)
        return json.dumps({"chapter_deps": [{"prereq_chapter": a, "target_chapter": b} for a in chapters for b in [*chapters, "无"] if a < b or b == "无"]})
    names = re.findall(r"^- ([^（\n]+)", body, re.M)
    if "目标章" in head:
        first, second = body.split("目标章：")
        return json.dumps({"edges": [{"source": re.search("- (.+?)（", first)[1], "target": re.search("- (.+?)（", second)[1], "type": "PREREQUISITE", "description": "跨章"}]})
    if "本章" in head:
        return "```json\n" + json.dumps({"edges": [{"source": b, "target": a, "type": "PREREQUISITE", "description": "章内"} for a, b in zip(names, names[1:], strict=False)]}) + "\n```"
    if '"tests"' in head:
        listed = body.split("题干：")[0].split("\n")[1:-1]
        return json.dumps({"tests": [{"concept": n, "description": ""} for n in listed if n in body.split("题干：")[1]]})
    if '"edges"' in head:
        listed = body.split("原文：")[0].split("\n")[1:-1]
        return json.dumps({"edges": [{"source": "thread", "target": "进程", "type": "PART_OF", "description": "d"}, {"source": listed[0], "target": listed[1], "type": "RELATED"}, {"source": listed[1], "target": listed[0], "type": "RELATED"}, {"source": "无", "target": "进程", "type": "RELATED"}]})
    if "results" in head:
        return json.dumps({"results": [{"is_prerequisite": True, "description": " 扫描 "} for _ in re.findall(r"^\d+\. A=", body, re.M)]})
    return json.dumps({"confusable": True, "dimensions": "x", "description": "y"})


def test_drivers(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "source string, page int, text string")
    chapters = X.page_chapters(pages)
    assert {(r["chapter"], r["prefix"]) for r in chapters.collect()} == {("1.进程", "CH1"), ("2.内存", "CH2")}
    assert X.page_chapters(pages, only=[2]).count() == 1
    by_hand = X.page_chapters(pages, chapter_name="手 册", last=10).first()
    assert (by_hand["chapter"], by_hand["prefix"], by_hand["number"]) == ("手 册", "手册", None)

    ask = calls.Asker(model, str(tmp_path / "log"))
    got = X.extract_candidates(chapters, ask)
    c = {r["name"]: r for r in got["concepts"].collect()}
    assert set(c) == set(CONCEPTS) and c["线程"]["aliases"] == ["thread"] and c["线程"]["difficulty"] == 2 and c["内存"]["chapter"] == "2.内存"
    assert c["进程"]["chapter"] == "1.进程" and c["进程"]["aliases"] == ["process"]
    assert [(r["pid"], r["stem"]) for r in got["problems"].orderBy("pid").collect()] == [("CH1_Q1", "什么是进程？"), ("CH1_Q2", "比较进程和线程。")]
    assert sorted(r["chunk_id"] for r in got["chunks"].collect()) == ["book_1.进程_C001", "book_2.内存_C001"]
    # again over what there is: nothing new
    again = X.extract_candidates(chapters, ask, existing=got)
    for k in got:
        assert again[k].drop("ord").exceptAll(got[k].drop("ord")).count() == 0 and again[k].count() == got[k].count()

    report = spark.createDataFrame([("进程", "线程", 0.9, (False,))], "name_a string, name_b string, confidence double, decision struct<merge boolean>")
    edges, side = X.extract_edges(got["concepts"], ask, got["chunks"], got["problems"], [report])
    found = {(r["type"], r["source"], r["target"]) for r in edges.collect()}
    assert {x for x in found if x[0] == "TESTS"} == {("TESTS", "CH1_Q1", "进程"), ("TESTS", "CH1_Q2", "进程"), ("TESTS", "CH1_Q2", "线程")}
    assert ("PART_OF", "线程", "进程") in found and ("CONFUSABLE", "进程", "线程") in found
    assert sum(t == "RELATED" for t, _, _ in found) == 2  # one a chunk, whichever end comes first
    pre = {(s, t) for k, s, t in found if k == "PREREQUISITE"}
    assert ("进程", "线程") in pre and any(r["description"] == "跨章" for r in edges.collect()) and ("内存", "分页") in pre
    assert {(r["source"], r["target"]) for r in side.collect()} == pre and all(r["reviewed"] is False for r in side.collect())
    known = {r["description"] for r in edges.where("type = 'PREREQUISITE'").collect()}
    assert known <= {"章内", "跨章", "扫描"}

    # only PREREQUISITE, over an earlier result
    fresh, _ = X.extract_edges(got["concepts"], ask, existing=edges)
    assert {(r["type"], r["source"], r["target"]) for r in fresh.collect()} == found
    none, side = X.extract_edges(got["concepts"].limit(0), ask, got["chunks"], got["problems"])
    assert none.count() == 0 and side.count() == 0


def test_known_parts_are_told(spark):
    rows = [(f"n{i}", "d" * 150, "c", 1 + i % 3, "概念", [], i) for i in range(30)]
    c = spark.createDataFrame(rows, "name string, definition string, chapter string, difficulty int, node_role string, aliases array<string>, ord long")
    part = spark.createDataFrame([("n2", "n5"), ("n2", "n0"), ("n2", "elsewhere")], "source string, target string")
    prompts = []

    def client(p):
        return json.dumps({"edges": [{"source": p, "target": "n1", "type": "PREREQUISITE"}]})

    prompts = [r["source"] for r in X.prerequisites_in_batches(c, part, client).collect()]
    assert len(prompts) == 2 and all("d" * 101 not in p for p in prompts)
    assert [len(re.findall("^- ", p, re.M)) for p in sorted(prompts, key=lambda p: "- n2（" not in p)] == [20, 15]
    told = [p for p in prompts if "  n2 → n5" in p]
    assert len(told) == 1 and all("elsewhere" not in p for p in prompts)


def test_a_lost_call_gives_nothing(spark):
    chunks = spark.createDataFrame([("c", "一段", 0), ("c", "二段", 1)], "chapter string, text string, ord int")

    def client(p):
        if "一段" in p:
            raise OSError("lost")
        return json.dumps({"concepts": [{"name": "甲", "definition": "足够长的定义"}]})

    assert [r["name"] for r in X.concepts_from_chunks(chunks, calls.Asker(client, tries=1)).collect()] == ["甲"]
    assert X.concepts_from_chunks(chunks, lambda p: "[1, 2]").count() == 0
    assert X.chapter_dependencies(chunks.select(F.lit("x").alias("name"), F.lit("").alias("chapter"), F.lit("").alias("definition"), F.lit(1).alias("difficulty"), "ord"), lambda p: 1 / 0).count() == 0
