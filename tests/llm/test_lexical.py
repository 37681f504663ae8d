"""Lexical ranking against plain Python."""

import math
import random
import re

import numpy as np
import pytest

from cairn.llm import lexical, queries
from tests.compare import by_sql, rows


def _terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    docs = [(i, _terms(t)) for i, t in docs]
    docs = [(i, ts) for i, ts in docs if ts]
    n_docs, n_terms = len(docs), sum(len(ts) for _, ts in docs)
    df = {}
    for _, ts in docs:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if _terms(t):
            asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, have in docs:
            m = 50 + (50 * len(have) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * have.count(t)) // (1000 * have.count(t) + 20 * m)) for t in ts if t in have)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS, ITEMS = "doc_id long, text string, score string, rank string, item_id string", "item_id long, text string, doc_id string"


def got(spark, docs, items, parts=5, **kw):
    d = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in docs], DOCS).repartition(parts)
    return sorted((tuple(r) for r in lexical.rank(d, spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS), **kw).collect()), key=str)


@pytest.mark.parametrize(("k", "block_docs", "part_bytes"), [(50, 4096, 1 << 20), (4, 7, 1 << 20), (3, 16, 60)])
def test_against_brute_force(spark, k, block_docs, part_bytes):
    rng = random.Random(k)
    words = ["a", "B", "ß", "Straße", "x1", "ÉTÉ", "日本", "d", "e", "f"] + [f"w{i}" for i in range(30)]
    docs = [(rng.randrange(-40, 200), " .".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randrange(0, 30)))) for _ in range(150)]
    docs += [(None, None), (None, "a b w1"), (None, "a b w1"), (5, "a b w1"), (5, "a b w1"), (-7, ""), (900, "\x00 -- \x7f"), (901, "a " * 40000 + "w29")]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(9)] + [(None, "a w2"), (3, "w3"), (20, None), (21, "?!"), (22, "nowhere"), (23, "w29 w29 W29")]
    assert got(spark, docs, items, k=k, block_docs=block_docs, part_bytes=part_bytes) == brute(docs, items, k)


def test_ties_rank_by_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(i, "other") for i in range(1000, 1400)]
    assert [r[:3] for r in sorted(got(spark, docs, [(1, "words")], k=50, block_docs=16), key=lambda r: r[1])] == [(1, i, i) for i in range(1, 51)]


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == []
    assert got(spark, [(1, "a")], []) == []
    assert got(spark, [(1, None)], [(1, None), (2, "")]) == []


def test_product_is_a_sparse_matrix_product():
    rng = np.random.default_rng(1)
    a, b = rng.random((6, 20)) < 0.3, np.where(rng.random((20, 33)) < 0.2, rng.integers(1, 1 << 40, (20, 33)), 0)
    term, doc = np.nonzero(b)
    shuffled = rng.permutation(len(term))
    best = lexical.Best(6, 100)
    lexical.product([np.flatnonzero(r) for r in a], (np.arange(33), np.zeros(33, bool)), term[shuffled], doc[shuffled], b[term, doc][shuffled], 33, best)
    want = a.astype(np.int64) @ b
    for i in range(6):
        assert dict(zip(best.doc[i].tolist(), best.score[i].tolist(), strict=True)) == {d: s for d, s in enumerate(want[i].tolist()) if s}


def test_query_agrees_with_sql(spark, sf):
    assert rows(queries.op13_lexical(spark, sf).toPandas()) == rows(by_sql(queries.ORACLE_SQL["op13_lexical"], sf))
