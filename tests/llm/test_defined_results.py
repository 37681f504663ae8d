"""Nulls, repeated rows, empty and long texts, and columns with clashing names, through Spark."""

import hashlib

import pytest

from cairn.llm import bpe, fingerprint, queries, toxicity

TEXTS = [None, "", "plain words here", "plain words here", "long " * 20000, "é\U0001f600 x", " \t\n"]
#: Names that the operators use themselves.
COLUMNS = "doc_id long, text string, _id string, _text string, _carry0 string, score string, n_tokens string, fingerprint string"


@pytest.fixture(scope="module")
def rows_(spark):
    ids = [1, 2, 3, 3, 4, 5, None]
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in zip(ids, TEXTS, strict=True)], COLUMNS)


def test_toxicity(spark, rows_):
    labels = spark.createDataFrame([(1, None), (2, 0), (3, 1), (None, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.score(rows_, toxicity.fit(rows_, labels), carry=("_text", "_carry0", "score")).drop("score")
    assert got.columns == ["doc_id", "predicted", "_text", "_carry0"]
    got = toxicity.score(rows_, toxicity.fit(rows_, labels), carry=("_carry0",)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["_carry0"] == "c" for r in got)
    by_id = {i: {r["score"] for r in got if r["doc_id"] == i} for i in (1, 2, 3)}
    assert by_id[1] == by_id[2] and len(by_id[3]) == 1


def test_bpe(rows_):
    got = bpe.encode_documents(rows_, queries.bpe_path()).collect()
    decoded = sorted(r["decoded_sha256"] for r in got)
    assert decoded == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS)
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1: 0, 2: 0}


def test_fingerprints(rows_):
    got = fingerprint.edited_fingerprints(rows_).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(t or "") for t in TEXTS)
    same = {r["fingerprint"] for r in got if r["doc_id"] == 3}
    assert len(same) == 1 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {r["fingerprint"] for r in got if not r["n_chars"]}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    row = {f.name: None for f in schema}
    full = [{**row, "doc_id": i, "text": t, "source": s} for i, t, s in [(1, None, None), (2, "", "a"), (3, "some words " * 9, "a"), (3, "some words " * 9, "a"), (None, "other words", None)]]
    for rows in ([], full):
        for name, stage in p.STAGES:
            docs = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns or name == "bpe"
            kept = {(r["doc_id"]) for r in out.collect()}
            if name in ("line_dedup", "bpe"):
                assert kept == {r["doc_id"] for r in rows}
            if name == "near_dedup":
                # the null text and the empty one are copies of each other
                assert kept == ({1, 3, None} if rows else set())
