"""JSON arrays by many tasks, against json."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import schema as S
from cairn.sources import json_array as A
from cairn.sources import json_files as J


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.text('a{}[]"\\,é', max_size=6) | st.integers(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k{"\\', max_size=3), x, max_size=3), max_leaves=12))
def test_walk_knows_strings(value):
    text = json.dumps(value, ensure_ascii=False)
    assert A.walk(text, False) == (False, 0)
    for cut in range(len(text) + 1):
        inside, depth = A.walk(text[:cut], False)
        if not text[:cut].endswith("\\"):
            after, rest = A.walk(text[cut:], inside)
            assert (after, depth + rest) == (False, 0)


SCHEMA = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("n", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])


@pytest.mark.parametrize("indent", [None, 2])
def test_a_split_file_comes_back_in_order(spark, tmp_path, indent):
    rng = random.Random(3)
    odd = ['}{', '"', "\\", '\\"}', "é漢", "\n", "][", ",", "}" * 9]
    rows = [{"i": i, "s": "".join(rng.choices(odd, k=rng.randrange(6))), "n": {rng.choice(odd): rng.choices(odd, k=rng.randrange(3)) for _ in range(rng.randrange(3))}} for i in range(400)]
    rows[200]["s"] = '}"{' * 4000  # one object over many ranges
    p = tmp_path / "a.json"
    p.write_text(json.dumps(rows, ensure_ascii=False, indent=indent), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = A._pieces(spark, str(p))
        assert found.select("lo").distinct().count() > 30  # read by many tasks
        got = A.read_array(spark, str(p), SCHEMA).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["ord"] for r in got] == list(range(400))
    assert [{"i": r["i"], "s": r["s"], "n": r["n"]} for r in got] == rows


@pytest.mark.parametrize("text", ["", " ", "{}", '{"name": "a"}', "[1, 2]", '[{"name": "a"}', '[{"name": "a"}}]', '[{"name": "a"} {"name": "b"}]', '[{"name": "a"}, 2]', '[[{"name": "a"}]]', '[{"name": "a"}]]', '["a", {"name": "b"}]', '[{"name": "a}]', "null"])
def test_what_is_no_array_of_objects(spark, tmp_path, text):
    p = tmp_path / "x.json"
    p.write_text(text)
    with pytest.raises(A.NotAnArray):
        A.read_array(spark, str(p), S.CHUNK)
    assert A.read_array(spark, str(p), S.CHUNK, missing_ok=True).count() == 0


def test_broken_objects_and_empty_arrays(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('[{"chunk_id": "a"}, {"chunk_id": tru}]')
    assert A.read_array(spark, str(p), S.CHUNK, missing_ok=True).count() == 0
    with pytest.raises(Exception, match="MALFORMED"):
        A.read_array(spark, str(p), S.CHUNK).collect()
    p.write_text(" [ \n ] \n")
    assert A.read_array(spark, str(p), S.CHUNK).count() == 0


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 7)
    path, one = str(tmp_path / "concepts"), str(tmp_path / "concepts.json")
    rows = [(f"n{i}", 'say "}"\n' * (i % 3), "c", i % 4 or None, None, ["x", "é"] if i % 2 else None, 100 - i) for i in range(50)]
    c = spark.createDataFrame(rows, "name string, definition string, chapter string, difficulty int, node_role string, aliases array<string>, ord long")
    J.write_array(c, path)
    A.join_parts(spark, path, one)
    want = [dict(zip(("name", "definition", "chapter", "difficulty", "node_role", "aliases"), r[:6], strict=True)) for r in reversed(rows)]
    with open(one, encoding="utf-8") as f:
        text = f.read()
    assert json.loads(text) == want and text == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
    for p in (path, one):
        got = J.read_concepts(spark, p).orderBy("ord")
        assert [r["name"] for r in got.collect()] == [r["name"] for r in want]
        assert got.select("name", "definition", "aliases").exceptAll(c.select("name", "definition", "aliases")).count() == 0
    # a file is extended over itself
    more = J.read_concepts(spark, path).unionByName(J.read_concepts(spark, path).withColumn("ord", F.col("ord") + 50))
    J.write_array(more, path, indent=None)
    assert J.read_concepts(spark, path).count() == 100
    J.write_array(c.limit(0), path)
    assert J.read_concepts(spark, path).count() == 0
    J.write_array(c.drop("ord").coalesce(1), path)
    assert [r["name"] for r in J.read_concepts(spark, path).orderBy("ord").collect()] == [r[0] for r in rows]


def test_other_readers(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
        return str(tmp_path / name)

    problems = put("p.json", [{"pid": "2", "stem": "b"}, {"pid": "1", "stem": " "}, {"pid": "2", "stem": "c"}])
    got = J.read_problems(spark, str(tmp_path / "none.json"), problems)
    from cairn.operators import concepts as C

    assert [(r["pid"], r["stem"]) for r in C.dedupe_problems(C.with_stem(got)).collect()] == [("2", "b")]
    with pytest.raises(FileNotFoundError):
        J.read_problems(spark, str(tmp_path / "none.json"))
    edges = put("e.json", [{"type": "RELATED", "source": "a", "target": "b", "reviewed": False}])
    assert J.read_edges(spark, edges).first()["reviewed"] is False
    questions = put("q.json", [{"question": "?", "answer": "!", "hops": 2, "path": ["a", "b", "c"], "type": "t"}])
    assert J.read_questions(spark, questions).first()["path"] == ["a", "b", "c"]
    base = put("k.json", {"concepts": [{"name": "a", "total_weight": 1.5, "sources": ["s"]}], "relations": [], "chapters": [{"number": 1, "title": "t", "topics": ["x"]}], "formulas": [{"name": "f"}]})
    kb = J.read_knowledge_base(spark, base).first()
    assert kb["concepts"][0]["total_weight"] == 1.5 and kb["chapters"][0]["topics"] == ["x"] and kb["relations"] == []
    report = put("r.json", {"vector_rag": {"accuracy": 1.0, "details": [{"question": "q", "correct": True}]}, "graph_rag": {"accuracy": 0.0, "details": []}})
    assert [(r["method"], r["correct"]) for r in J.read_evaluation(spark, report).collect()] == [("vector_rag", True)]
    assert J.read_evaluation(spark, str(tmp_path / "none.json")).count() == 0
