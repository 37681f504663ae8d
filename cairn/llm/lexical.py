"""Ranked lexical search as a blocked sparse matrix product.

Items are the rows of a matrix item x term, documents the columns of a matrix
term x document of 64-bit impacts. A first pass over the texts counts each
document's terms and keeps those that some item has; N, L and the document
frequencies are sums over its output. The second pass takes documents in blocks:
a block's postings are put in term order, and for each item the rows of its terms
are merged into one row of scores (Gustavson's way, with a dense accumulator as
wide as the block). Only a block's best k of an item go on; a task keeps the best
k over its blocks, and two rankings reduce the tasks' rows.

Whatever is broadcast comes from the items of one part, and items are cut into
parts by the bytes of their texts; documents are never collected or broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.text import column, each
from cairn.session import materialize

TOP, BLOCK_DOCS = 50, 4096
#: Bytes of items' texts that one pass over the documents may hold; more items are searched in parts.
PART_BYTES = 32 << 20
#: Rankings of an item that run side by side before the last one.
SPLITS = 64
#: Maximal runs of digits, letters A-Z and everything beyond ASCII, on UTF-8.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: bytes | None) -> list[bytes]:
    """A text's terms in order; only A-Z are lowered. Null has none."""
    return TERM.findall(text.lower()) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 20 m)) of each posting, in 64-bit integers."""
    m = 50 + (50 * n * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The best k documents of each item so far, by score and then by id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.floor[item])
        if not len(at):
            return
        if len(at) > self.k:  # what equals the k-th score stays for its id
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        s, d, z = np.r_[self.score[item], scores[at]], np.r_[self.doc[item], docs[at]], np.r_[self.null[item], nulls[at]]
        order = np.lexsort((d, z, -s))[: self.k]
        self.score[item], self.doc[item], self.null[item] = s[order], d[order], z[order]
        if len(order) == self.k:
            self.floor[item] = s[order[-1]]


def product(rows: list[np.ndarray], docs: tuple[np.ndarray, np.ndarray], term: np.ndarray, doc: np.ndarray, impact: np.ndarray, width: int, best: Best) -> None:
    """One block: rows[i] are item i's terms; term, doc and impact are the block's postings, doc a place in the block."""
    order = np.argsort(term, kind="stable")
    term, doc, impact = term[order], doc[order], impact[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(term)]
    there = term[first]
    for item, wanted in enumerate(rows):
        at = np.searchsorted(there, wanted)
        at = at[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == wanted)] if len(there) else at[:0]
        if not len(at):
            continue
        acc = np.zeros(width, np.int64)
        for a, z in zip(first[at].tolist(), ends[at].tolist(), strict=True):
            acc[doc[a:z]] += impact[a:z]  # a term has each document once
        best.add(item, acc, *docs)


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """_id, n and the parallel lists term and tf of every document that has a term at all."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            keep, n, found, tf = [], [], [], []
            for i, text in enumerate(each(b, "_text")):
                ts = terms(text)
                if ts:
                    mine = [(known[t], c) for t, c in Counter(ts).items() if t in known]
                    keep.append(i)
                    n.append(len(ts))
                    found.append([t for t, _ in mine])
                    tf.append([c for _, c in mine])
            yield pa.record_batch([b.column("_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["_id", "n", "term", "tf"])

    return docs.mapInArrow(read, "_id long, n long, term array<int>, tf array<long>")


def _frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the vocabulary's terms: counted in tasks, at most a row a term to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column("term").flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in postings.select("term").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def _search(docs: DataFrame, items: dict[int | None, set[bytes]], k: int, block_docs: int) -> DataFrame:
    """One part of the items against all documents."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    postings = materialize(_postings(docs, vocabulary), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(postings, len(vocabulary))
    weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)
    rows = [np.array(sorted(vocabulary[t] for t in ts), np.int64) for ts in items.values()]
    shared = spark.sparkContext.broadcast((list(items), rows, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, weights = shared.value
        best = Best(len(ids), k)
        for whole in batches:
            for lo in range(0, whole.num_rows, block_docs):
                b = whole.slice(lo, block_docs)
                doc_id, n = b.column("_id"), b.column("n").to_numpy()
                doc = np.repeat(np.arange(b.num_rows), b.column("term").value_lengths().to_numpy(zero_copy_only=False))
                term, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "tf"))
                nulls = doc_id.is_null().to_numpy(zero_copy_only=False)
                product(rows, (doc_id.fill_null(0).to_numpy(zero_copy_only=False), nulls), term, doc, impacts(tf, n[doc], weights[term], n_docs, n_terms), b.num_rows, best)
        for at in range(0, len(ids), 4096):
            some = range(at, min(at + 4096, len(ids)))
            sizes = [len(best.score[i]) for i in some]
            if sum(sizes):
                item = pa.array([ids[i] for i, c in zip(some, sizes, strict=True) for _ in range(c)], pa.int64())
                got = [np.concatenate([x[i] for i in some]) for x in (best.doc, best.null, best.score)]
                yield pa.record_batch([item, pa.array(got[0], pa.int64(), mask=got[1]), pa.array(got[2], pa.int64())], ["item", "doc", "score"])

    found = postings.mapInArrow(search, "item long, doc long, score long")
    order = (F.col("score").desc(), F.col("doc").asc_nulls_last())
    split = F.pmod(F.xxhash64("doc"), F.lit(SPLITS))
    found = found.withColumn("_at", F.row_number().over(Window.partitionBy("item", split).orderBy(*order))).where(F.col("_at") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("_at")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score, all scores above 0.

    Every row of docs is a document of its own; rows that repeat an id are scored
    each, and a null id ranks after all others of its score. Equal scores rank by
    ascending id. Rows of items that repeat an id are one item with the terms of
    all of them, a null id is an item too; an item without terms, and one whose
    terms no document has, gives no row. Null and empty texts have no terms and
    count neither for N nor for L. Texts of any length are read whole. Items above
    part_bytes are searched in parts, each against all documents. Empty tables give
    an empty result. Other columns are left out, so that their names cannot clash.
    """
    corpus = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    asked = items.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text_col).cast("string").cast("binary").alias("_text")).where("_text is not null")
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0) // part_bytes))
    out = None
    for part in range(parts):
        mine: dict[int | None, set[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("_item"), F.lit(parts)) == part).toLocalIterator():  # part_bytes of text, by the sum above
            mine.setdefault(r["_item"], set()).update(terms(bytes(r["_text"])))
        mine = {i: ts for i, ts in mine.items() if ts}
        found = _search(corpus, mine, k, block_docs) if mine else docs.sparkSession.createDataFrame([], "item long, doc long, score long, rank int")
        found = materialize(found, "ranked") if parts > 1 else found
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
