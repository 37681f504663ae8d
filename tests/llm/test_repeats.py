"""Rows that repeat an id, and rows without one, in substring dedup and WARC."""

import base64
import hashlib
import random

from cairn.llm import substring_dedup, warc

WINDOW = 20


def _remove(rows, window=WINDOW):
    """Brute force over (id, text): documents are distinct pairs, by id (null first) and then by digest."""
    order = sorted({(i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), (t or "")) for i, t in rows})
    seen, out = set(), {}
    for has_id, i, _, t in order:
        ws, gone = t.encode().split(), set()
        for at in range(len(ws) - window + 1):
            w = tuple(ws[at : at + window])
            if w in seen:
                gone |= set(range(at, at + window))
            seen.add(w)
        out[(i if has_id else None, t)] = (len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode())
    return sorted(((i, *out[(i, t or "")]) for i, t in rows), key=str)


def _check(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, _doc string, _text string, n_words string").repartition(3)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == _remove(rows)


def test_repeated_and_null_ids(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(words, k=30))
    rows = [(rng.choice([None, 1, 2, 3, -5]), " ".join([*rng.choices(words, k=rng.randrange(40)), passage if rng.random() < 0.4 else "x"])) for _ in range(40)]
    rows += [(7, "short"), (7, f"{passage} {passage} tail " * 3), (7, None), (None, f"{passage} {passage}"), (None, "tiny"), (None, None), (8, passage), (8, passage)]
    _check(spark, rows)


def test_one_id_for_all(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    _check(spark, [(None, f"{passage} {i} {passage}") for i in range(30)])
    _check(spark, [(4, f"{i} {passage}") for i in range(30)] + [(4, "x")])


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_unlike_payloads_of_one_page(spark):
    rng = random.Random(1)
    long = ["".join(rng.choices("abcdeé\n ", k=n)) for n in (90_000, 150_000, 33_000)]
    data = [(1, "u1", long[0]), (1, "u1", long[1]), (1, "u2", long[2]), (1, None, ""), (1, "u", None), (2, "v", long[1]), (3, "v", long[1]), (3, "v", long[0]), (3, "v", long[0]), (None, "v", long[0])]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in data], "page_id long, url string, html string, payload_digest string, d string").repartition(4)
    got = warc.round_trip(pages).collect()
    assert all(r["verified"] for r in got)
    last = {}
    for p, _, h in data:
        if p is not None:
            last[h or ""] = max(last.get(h or "", p), p)
    want = [(p, len((h or "").encode()), _digest(h), "response" if last[h or ""] == p else "revisit", None if last[h or ""] == p else last[h or ""]) for p, _, h in data if p is not None]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)


def test_many_pages_of_one_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # the way for more repeated payloads than one broadcast holds
    monkeypatch.setattr(warc, "FILE_RECORDS", 50)
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else "other") for i in range(400)], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.round_trip(pages).collect()}
    assert got == {i: None if i in (398, 399) else 398 if i % 3 else 399 for i in range(400)}
