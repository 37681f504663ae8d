"""Substring deduplication by level-wise doubling.

A passage is repeated if a window of WINDOW consecutive words is. Windows are
looked for at shorter lengths first (START words, then twice as many, up to
WINDOW); only what is repeated at one length goes on to twice that length:

* At the shorter lengths a window is judged by its minimizer, the part of that
  length whose hash is smallest: equal windows have it at the same place. Twin
  Bloom filters say which parts may occur twice. A window whose part does not is
  dropped; no window that occurs twice ever is.
* At the full length the surviving windows are compared by 96 bits of two hash
  lanes. Each task first settles its own repeats and sends on one sighting of
  each window, so a passage that a third of all documents hold meets itself once a
  task, not once a document. Words themselves are not compared again: two
  windows of unlike words would be taken for one if all 96 bits collided. Sightings travel packed, by hash bucket.

Each level reads the texts anew; texts are moved once, to meet their verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.bloom import bits_for, has, seen_twice
from cairn.llm.text import U64, column, each, mix, ngrams, octets, runs, text_of, word_hashes_wide
from cairn.session import materialize
from cairn.sources.frames import numbered_over_all

WINDOW = 20
#: The shortest length looked at, if WINDOW is a power of two times it.
START = 5
HASHES, BITS_PER_PART, OCTETS_PER_PART = 3, 12, 50
#: Words that are hashed at once: whole documents, whatever their number.
AT_ONCE = 150_000
#: Sightings that a task gathers before it settles them, and that a hash bucket should hold.
FLUSH, BUCKET = 1_500_000, 1_000_000
OCTETS_PER_WINDOW = 6


def levels(window: int) -> list[int]:
    """Lengths below `window`, doubling up to it: 5 and 10 for 20; 5, 10, 20, 40 for 80."""
    out = [window]
    while out[0] % 2 == 0 and out[0] > START:
        out.insert(0, out[0] // 2)
    return out[:-1]


def doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of windows of 2k words from those of k words."""
    if len(h) <= k:
        return h[:0]
    return mix(h[:-k] * U64(0x9E3779B97F4A7C15) + (h[k:] ^ (h[k:] >> U64(29))) * U64(0xC2B2AE3D27D4EB4F))


def minimizers(part: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` parts, the position of the smallest hash, the first among equals."""
    n = len(part) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(mix(part), width)
    return view.argmin(1) + np.arange(n)


class Survivors:
    """Which windows of some documents are still candidates after the filters of the shorter lengths."""

    def __init__(self, window: int, filters: list[np.ndarray]):
        self.window, self.filters, self.levels = window, filters, levels(window)

    def __call__(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the parts at the length after the filters', the windows' starts in all words, the documents' first words, lane 1, lane 2 of word hashes)."""
        sizes = np.array([len(d) for d in docs])
        first = np.cumsum(sizes) - sizes
        a, b = word_hashes_wide([w for d in docs for w in d])
        # a window lies within one document
        room = np.repeat(first + sizes, sizes) - np.arange(len(a)) >= self.window
        starts = np.flatnonzero(room)
        part, size = None, 0
        for i, length in enumerate(self.levels):
            part = ngrams(a, length) if part is None else doubled(part, size)
            size = length
            if not len(starts):
                break
            at = minimizers(part, self.window - length + 1)[starts]
            new = np.r_[True, at[1:] != at[:-1]]  # starts ascend, and so do their minimizers
            used = at[new]
            if i == len(self.filters):
                return part[used], starts, first, a, b
            starts = starts[has(self.filters[i], part[used], HASHES)[np.cumsum(new) - 1]]
        return a[:0], starts, first, a, b


def together(texts: Iterator[tuple[object, str]], window: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Documents of a window or more, some at a time: (ids, words)."""
    ids, docs, n = [], [], 0
    for i, t in texts:
        ws = t.encode().split()
        if len(ws) >= window:
            ids.append(i)
            docs.append(ws)
            n += len(ws)
            if n >= AT_ONCE:
                yield ids, docs
                ids, docs, n = [], [], 0
    if docs:
        yield ids, docs


def _filters(texts: DataFrame, window: int) -> list[np.ndarray]:
    """A twice-seen filter for each shorter length, each over what the one before let pass."""
    bits = bits_for(octets(texts, "_text") // OCTETS_PER_PART, BITS_PER_PART)
    found: list[np.ndarray] = []
    sc = texts.sparkSession.sparkContext
    for _ in levels(window):
        shared = sc.broadcast(list(found))

        def sightings(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            survive = Survivors(window, shared.value)
            got = [survive(docs)[0] for _, docs in together(((None, t) for t in each(batch, "_text")), window)]
            return np.concatenate(got) if got else np.zeros(0, U64)

        found.append(seen_twice(texts, sightings, bits, HASHES))
    return found


def _pack(h1, h2, doc, at) -> bytes:
    """20 bytes a sighting: 64 and 32 bits of hash, the document's place in a list of ids, the start."""
    ids, which = np.unique(doc, return_inverse=True)
    parts = (np.array([len(ids)], np.int64), ids, h1, h2, which.astype(np.int32), at)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    ids, o = np.frombuffer(blob, np.int64, k, 8), 8 + 8 * k
    n = (len(blob) - o) // 20
    h1, h2 = np.frombuffer(blob, U64, n, o), np.frombuffer(blob, np.uint32, n, o + 8 * n)
    return h1, h2, ids[np.frombuffer(blob, np.int32, n, o + 12 * n)], np.frombuffer(blob, np.int32, n, o + 16 * n)


def _settle(h1, h2, doc, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, earlier): sightings sorted by window, document and place; which are their window's first; which an earlier one precedes.

    Sightings of one place (rows that repeat a document) do not precede each other.
    """
    order = np.lexsort((at, doc, h1))
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # one lane collides: sort by both
        order = np.lexsort((at, doc, h2, h1))
        a, b = h1[order], h2[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))]
    return order, first, ~first & ((doc[order] != doc[lead]) | (at[order] != at[lead]))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text and _doc, one number for each document, in the order of documents.

    That is the id as long as no id has two unlike texts. Where one has, ids say
    neither which row a window lies in nor which of two rows is earlier: distinct
    pairs of id and text are then numbered over the whole table, by id and by the
    text's digest, and rows take the number of their pair.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    h = F.xxhash64("_text")
    if rows.groupBy("_id").agg((F.min(h) != F.max(h)).alias("unlike")).where("unlike").isEmpty():
        return rows.withColumn("_doc", F.coalesce("_id", F.lit(-(2**63))))
    rows = rows.withColumn("_sha", F.sha2("_text", 256))
    pairs = numbered_over_all(rows.select("_id", "_sha").distinct(), [F.col("_id").asc_nulls_first(), "_sha"], "_doc").select(F.col("_id").alias("_id2"), F.col("_sha").alias("_sha2"), "_doc")
    met = rows.join(pairs, (F.col("_sha") == F.col("_sha2")) & F.col("_id").eqNullSafe(F.col("_id2")))
    return materialize(met.select("_id", "_text", "_doc"), "documents")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of words that starts earlier too.

    Earlier: in a document with a smaller id, or before it in the same document.
    Windows are judged on the input. Returns id_col, n_words, n_removed, text (the
    words that stay, joined by one blank), one row for each input row. A null text
    has no words; texts shorter than a window keep all, and texts of any length are
    read whole. A null id is the smallest. Rows that repeat an id and its text are
    one document and get the same result; rows that repeat an id with unlike texts
    are documents of their own, in the order of their texts' SHA-256. An empty
    table gives an empty one. Other columns than those named are left out, so that
    their names cannot clash.
    """
    spark = docs.sparkSession
    rows = _documents(docs, id_col, text_col)
    filters = spark.sparkContext.broadcast(_filters(rows.select("_text"), window))
    total = octets(rows, "_text")
    buckets = max(8, total // OCTETS_PER_WINDOW // BUCKET)
    regions = max(8, total // (8 << 20))

    def spread(doc: np.ndarray) -> np.ndarray:
        return (mix(doc.astype(U64)) % U64(regions)).astype(np.int64)

    def verdicts(doc: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """Starts of repeated windows, packed by region of documents."""
        r = spread(doc)
        order = np.lexsort((at, doc, r))
        r, doc, at = r[order], doc[order], at[order]
        for lo, hi in zip(*runs(r), strict=True):
            yield int(r[lo]), doc[lo:hi].tobytes() + at[lo:hi].astype(np.int32).tobytes()

    def sight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            survive, held, n = Survivors(window, filters.value), [], 0
            for batch in batches:
                for ids, docs in together(zip(column(batch, "_doc"), each(batch, "_text"), strict=True), window):
                    _, starts, first, a, b = survive(docs)
                    if len(starts):
                        doc = np.searchsorted(first, starts, side="right") - 1
                        h1, h2 = ngrams(a, window, 11)[starts], (ngrams(b, window, 13)[starts] >> U64(32)).astype(np.uint32)
                        held.append((h1, h2, np.array(ids, np.int64)[doc], (starts - first[doc]).astype(np.int32)))
                        n += len(starts)
                    if n >= FLUSH:
                        yield flush(held)
                        held, n = [], 0
            if held:
                yield flush(held)

    def flush(held: list) -> pa.RecordBatch:
        h1, h2, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first, earlier = _settle(h1, h2, doc, at)
        # settled here already: sent on through any bucket
        out = [(r % buckets, r, blob) for r, blob in verdicts(doc[order[earlier]], at[order[earlier]])]
        o = order[first]
        r = (h1[o] % U64(buckets)).astype(np.int64)
        by = np.argsort(r, kind="stable")
        o, r = o[by], r[by]
        for lo, hi in zip(*runs(r), strict=True):
            x = o[lo:hi]
            out.append((int(r[lo]), None, _pack(h1[x], h2[x], doc[x], at[x])))
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "region", "blob"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one bucket of windows, those whose first sighting is elsewhere; verdicts pass through."""
        done = pdf["region"].notna()
        out = [(int(r), blob) for r, blob in zip(pdf.loc[done, "region"], pdf.loc[done, "blob"], strict=True)]
        if not done.all():
            h1, h2, doc, at = (np.concatenate(x) for x in zip(*map(_unpack, pdf.loc[~done, "blob"]), strict=True))
            order, _, earlier = _settle(h1, h2, doc, at)
            out += verdicts(doc[order[earlier]], at[order[earlier]])
        return pd.DataFrame(out, columns=["region", "blob"])

    found = rows.select("_doc", "_text").mapInArrow(sight, "bucket long, region long, blob binary").groupBy("bucket").applyInPandas(judge, "region long, blob binary")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document: the starts of its repeated windows. A region's blobs are all in one task."""
        got = [(np.frombuffer(x, np.int64, len(x) // 12), np.frombuffer(x, np.int32, len(x) // 12, 8 * (len(x) // 12))) for b in batches for x in column(b, "blob")]
        if got:
            doc, at = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            first, past = runs(doc)
            for i in range(0, len(first), 2000):
                lo, hi = first[i : i + 2000], past[i : i + 2000]
                yield pa.record_batch([pa.array(doc[lo], pa.int64()), pa.array([at[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())], ["_doc2", "_starts"])

    starts = found.repartition("region").mapInArrow(unpack, "_doc2 long, _starts binary")
    joined = rows.join(starts, F.col("_doc") == F.col("_doc2"), "left").select("_id", "_text", "_starts")
    schema = T.StructType().add("_id", "long").add("n_words", "long").add("n_removed", "long").add("_kept", "string")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, removed, kept = [], [], []
            for t, s in zip(each(b, "_text"), column(b, "_starts"), strict=True):
                ws = t.encode().split()
                if s:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    at = np.unique(np.frombuffer(s, np.int32))
                    edge[at] += 1
                    edge[at + window] -= 1
                    stay = np.cumsum(edge)[:-1] == 0
                    out = [w for w, k in zip(ws, stay.tolist(), strict=True) if k]
                else:
                    out = ws
                words.append(len(ws))
                removed.append(len(ws) - len(out))
                kept.append(b" ".join(out).decode())
            yield pa.record_batch([b.column("_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    out = joined.mapInArrow(keep, schema)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("_kept").alias(text_col))
