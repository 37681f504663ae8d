"""Which terms occur in which texts, for any number of terms.

A term occurs where its anchor does: of the pieces of GRAM characters in a term
(the whole of a shorter one) the anchor is the one that the fewest terms hold. A
Bloom filter of anchors, bounded in size, is all that tasks get to know of the
terms; a text gives only the pieces that may be anchors, and these meet the terms
by a join. What is joined is confirmed on the text itself, so the result is exact.
The texts are read once to find pieces and once more, where they have any, to be
confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import blooms
from cairn.functions import scalar as X
from cairn.session import materialize

GRAM = 8
#: Parts of the texts in which an anchor is found: it may be in a third of all texts.
SALTS = 8


def hashes(text: str, size: int) -> np.ndarray:
    """A hash of each piece of `size` characters, in order; of another size than GRAM it is another hash."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def anchors(terms: DataFrame) -> DataFrame:
    """(term, h, size): the anchor of each term (a column, term; not empty)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts, hs, ss = [], [], []
            for t in b.column(0).to_pylist():
                size = min(GRAM, len(t))
                found = np.unique(hashes(t, size))
                ts += [t] * len(found)
                hs.append(found)
                ss += [size] * len(found)
            yield pa.record_batch([pa.array(ts, pa.string()), pa.array(np.concatenate(hs) if hs else np.zeros(0, np.int64)), pa.array(ss, pa.int32())], ["term", "h", "size"])

    every = materialize(terms.select("term").distinct().mapInArrow(pieces, "term string, h long, size int"), "pieces")
    often = every.groupBy("h").agg(F.count("*").alias("n"))
    return every.join(often, "h").groupBy("term").agg(F.min_by(F.struct("h", "size"), F.struct("n", "h")).alias("a")).select("term", "a.h", "a.size")


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, n): terms (a column, term) that occur in texts (id, text) and how often, non-overlapping.

    Nulls and empty terms occur nowhere; rows that repeat an id are texts of their
    own, and their counts come in rows of their own.
    """
    spark = texts.sparkSession
    keyed = materialize(anchors(terms.where("term <> ''")), "anchors")
    sizes = sorted(r[0] for r in keyed.select("size").distinct().collect())  # at most GRAM
    bitmap = spark.sparkContext.broadcast(blooms.build(keyed.select("h").distinct()))
    rows = materialize(texts.select("id", "text", F.xxhash64("text").alias("_x")), "texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                at, hs = [], []
                for i, t in enumerate(b.column(2).to_pylist()):
                    for size in sizes:
                        h = hashes(t, size)
                        h = np.unique(h[blooms.has(bitmap.value, h)])
                        at.append(np.full(len(h), i))
                        hs.append(h)
                where = np.concatenate(at) if at else np.zeros(0, np.int64)
                yield pa.record_batch([b.column(0).take(pa.array(where, pa.int64())), b.column(1).take(pa.array(where, pa.int64())), pa.array(np.concatenate(hs) if hs else np.zeros(0, np.int64))], ["id", "_x", "h"])

    kind = texts.schema["id"].dataType.simpleString()
    pieces = rows.where("text <> ''").select("id", "_x", "text").mapInArrow(find, f"id {kind}, _x long, h long")
    # a frequent piece has many texts and few terms
    salted = keyed.select("h", "term", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "_x"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).select("id", "_x", "term").distinct()
    met = rows.join(pairs.select(F.col("id").alias("_id"), F.col("_x").alias("_y"), "term"), (F.col("_x") == F.col("_y")) & F.col("id").eqNullSafe(F.col("_id")))
    return met.where(F.contains("text", "term")).select("id", "term", X.count_of(F.col("text"), F.col("term")).alias("n"))
