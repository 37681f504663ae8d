"""Containment by anchors, similar pairs by cells, and vectors that do not fit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import blooms
from cairn.operators import containment, retrieval, similar


def test_terms_by_anchors(spark):
    rng = random.Random(2)
    letters = "abé漢𝒳 "
    texts = [(i % 40, "".join(rng.choices(letters, k=rng.randrange(60)))) for i in range(80)] + [(1, None), (None, "abab aba"), (2, ""), (5, "ab" * 5000)]
    terms = {"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 8, 9, 14]))) for _ in range(150)} | {"aba", "ab" * 20}
    terms |= {t[k : k + 12] for _, t in texts[:40] if t and len(t) > 20 for k in (0, 5)}
    rows = [(t, f"c{len(t)}") for t in sorted(terms)] + [(None, "n"), ("", "e"), ("aba", "other")]
    x, t = spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame(rows, "term string, canonical string")
    want = sorted(((i, term, c, text.count(term)) for i, text in texts if text for term, c in rows if term and term in text), key=str)
    for size in (0, 1 << 20):  # by the join, and by the automaton
        got = retrieval.mentions(x, t, size)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        assert retrieval.mentions(x, t.limit(0), size - 1).count() == 0


def test_millions_of_terms_are_not_broadcast(spark):
    terms = spark.range(2_000_000).select(F.concat(F.lit("term number "), F.col("id").cast("string")).alias("term"), F.lit("c").alias("canonical"))
    keyed = containment.anchors(terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in keyed and "LocalRelation" not in keyed
    assert blooms.MAX_BITS // 8 <= 32 << 20


def test_bloom_holds_its_keys(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 20_000)
    bitmap = blooms.build(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "h long"))
    assert blooms.has(bitmap, keys[:10_000]).all() and blooms.has(bitmap, keys[10_000:]).mean() < 0.02


def brute(rows, least):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((x / np.where(n > 0, n, 1)) @ (x / np.where(n > 0, n, 1)).T, 4)
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(*np.nonzero(s >= least), strict=True) if ids[a] != ids[b]}


def test_clustered_vectors_visit_few_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    at = rng.integers(0, 40, 900) * (rng.random(900) > 0.1)  # one cluster has more than the others
    rows = [(int(i), [float(x) for x in centres[c] + 0.05 * rng.normal(size=16)]) for i, c in enumerate(at)] + [(5000, [0.0] * 16), (5001, [0.0] * 16)]
    v = retrieval.usable(spark.createDataFrame(rows, "id int, vec array<double>"))
    cells = similar.Cells.of(v, len(rows), 0.9)
    assert cells.products() < 0.5 * len(rows) ** 2 / 2 and cells.visits.count() < 30 * len(rows)
    got = retrieval.similar_pairs(spark.createDataFrame(rows, "id int, vec array<double>"), 0.9, block=100)
    pairs = [(r["a"], r["b"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, 0.9)
    # without structure all blocks meet, with the same result
    loose = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    assert {(r["a"], r["b"]) for r in retrieval.similar_pairs(spark.createDataFrame(loose, "id int, vec array<double>"), 0.5, block=50).collect()} == brute(loose, 0.5)


@pytest.mark.parametrize("least", [0.8, -1.0])
def test_vectors_that_do_not_fit(spark, least):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.1, 0.0]), (9, [float("inf"), 0.0])]
    v = spark.createDataFrame(rows, "id int, vec array<float>")
    assert {(r["a"], r["b"]) for r in retrieval.similar_pairs(v, least).collect()} == {(1, 2), (3, 8)}
    got = retrieval.top_k(v, v, 3).collect()
    assert {(r["query"], r["id"]) for r in got} == {(a, b) for a in (1, 2) for b in (1, 2)} | {(a, b) for a in (3, 8) for b in (3, 8)}
