"""Vector codes against plain integer k-means."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import queries, vector_codes
from tests.compare import by_sql, rows


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 70), st.integers(1, 5), st.integers(1, 4), st.integers(0, 2**31))
def test_tree_search_is_brute_force_with_ties(entries, width, spread, seed):
    rng = np.random.default_rng(seed)  # a narrow spread makes equal entries and equal distances
    points, x = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-spread - 1, spread + 2, (40, width))
    code, dist = vector_codes.nearest(vector_codes.tree(points), x)
    d = ((x[:, None] - points[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (dist == d.min(1)).all()


def brute(table, parts, entries, rounds):
    """table: (id, vector, label), vectors all of one length that parts divides."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = {i: [v[p * w : p * w + w] for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def assign():
        return {i: [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for p, x in enumerate(xs)] for i, xs in cut.items()}

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut[i][p] for i in cut if got[i][p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = assign()
    error = {i: sum(d for d, _ in got[i]) for i in got}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {}
    for i, _, lab in kept:
        by_label[lab] = by_label.get(lab, 0) + error[i]
    return {(i, "".join(f"{e:02x}" for _, e in got[i]), error[i], by_label[lab], digest) for i, _, lab in kept}


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def frame(spark, table):
    return spark.createDataFrame([(i, v, lab, "clash", "clash") for i, v, lab in table], SCHEMA).repartition(5)


@pytest.mark.parametrize(("entries", "broadcast_bytes"), [(64, 1 << 20), (5, 0)])
def test_against_brute_force(spark, entries, broadcast_bytes):
    rng = np.random.default_rng(4)
    table = [(int(i) * 3 - 50, [float(x) for x in np.round(rng.normal(size=8) * (3 if i % 9 == 0 else 0.05), 2)], None if i % 3 else int(i) % 2) for i in rng.permutation(150)]
    table += [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (-1002, [float("nan")] + [0.0] * 7, None), (1003, [float("-inf")] * 8, 0)]
    got = vector_codes.compress(frame(spark, table), parts=4, entries=entries, broadcast_bytes=broadcast_bytes).collect()
    assert {tuple(r) for r in got} == brute(table, 4, entries, 2)
    assert len(got) == 150


def test_odd_tables(spark):
    assert vector_codes.compress(frame(spark, []).limit(0)).collect() == []
    # fewer ids than entries, repeats, ties, null ids, other lengths, components beyond the range
    table = [(2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (2, [0.0, 2.0], 2), (7, [9.0, 9.0], None), (None, [9.0, 9.0], None), (8, [1.0], 3), (9, [1.0, 2.0, 3.0], None), (10, [3e38, -3e38], 4)]
    got = vector_codes.compress(frame(spark, table), parts=2).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(got) == len(table)
    assert len(by[2]) == 3 and len({r["error"] for r in by[2]}) == 2
    assert by[8][0]["code"] is None and by[8][0]["label_error"] is None
    assert by[9][0]["error"] is None and by[9][0]["label_error"] == by[7][0]["label_error"]
    assert by[None][0]["code"] == by[7][0]["code"] and by[10][0]["error"] == 0
    only_null = vector_codes.compress(frame(spark, [(None, [1.0, 2.0], 1)]), parts=2).collect()
    assert [tuple(r)[:4] for r in only_null] == [(None, None, None, None)]
    assert [r["code"] for r in vector_codes.compress(frame(spark, [(1, [], 1), (2, [], 1)]), parts=2).collect()] == ["0000", "0000"]
    # three components in two parts: a zero follows
    three = vector_codes.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]), parts=2).collect()
    assert three[0]["codebooks_sha256"] == hashlib.sha256(b"256,512,768,0").hexdigest()


def test_query_agrees_with_sql(spark, sf):
    assert rows(queries.op12_vector_codes(spark, sf).toPandas()) == rows(by_sql(queries.ORACLE_SQL["op12_vector_codes"], sf))
