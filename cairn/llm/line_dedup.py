"""Line deduplication with two Bloom filters.

Pass 1 fills a once-seen and a twice-seen filter with the hashes of each
document's long line keys. Pass 2 sends on only the lines whose hash may have
been seen twice; these suspects are grouped by the exact key, which settles
false suspects, the number of documents and the document that keeps the line.
Lines that occur once never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.bloom import bits_for, has, seen_twice
from cairn.llm.text import U64, column, each, octets, text_of
from cairn.session import bound_batches, materialize

MIN_CHARS, MIN_DOCS = 40, 5
STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
HASHES, BITS_PER_LINE, OCTETS_PER_LINE = 4, 16, 160
#: Bytes of shared keys that one broadcast may hold; more keys meet their lines by a join, a key's lines in SALTS parts.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def long_keys(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines whose key has min_chars code points or more."""
    for at, line in enumerate(text.encode().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(STRIP).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                yield at, key


def _suspects(docs: DataFrame, min_chars: int) -> DataFrame:
    bits = bits_for(octets(docs, "_text") // OCTETS_PER_LINE, BITS_PER_LINE)

    def sightings(batch: pa.RecordBatch) -> np.ndarray:
        found = [h for t in each(batch, "_text") for h in {xxhash.xxh3_64_intdigest(k) for _, k in long_keys(t, min_chars)}]
        return np.array(found, U64)

    twice = seen_twice(docs.select("_text"), sightings, bits, HASHES)
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                ids, rows, keys, at, hashes = [], [], [], [], []
                for i, r, t in zip(column(b, "_id"), column(b, "_row"), each(b, "_text"), strict=True):
                    mine: dict[bytes, list[int]] = {}
                    for n, k in long_keys(t, min_chars):
                        mine.setdefault(k, []).append(n)
                    ids += [i] * len(mine)
                    rows += [r] * len(mine)
                    keys += mine.keys()
                    at += mine.values()
                    hashes += map(xxhash.xxh3_64_intdigest, mine)
                keep = has(shared.value, np.array(hashes, U64), HASHES)
                if keep.any():
                    mask = pa.array(keep)
                    yield pa.record_batch([pa.array(x, t).filter(mask) for x, t in ((ids, pa.int64()), (rows, pa.int64()), (keys, pa.binary()), (at, pa.list_(pa.int32())))], ["_id", "_row", "key", "at"])

    return docs.select("_id", "_row", "_text").mapInArrow(pick, "_id long, _row long, key binary, at array<int>")


def _meet(suspects: DataFrame, shared: DataFrame) -> DataFrame:
    """Suspects of the shared keys, with the key's last document. A key may have a third of all lines: its lines are never brought together."""
    octets_ = shared.agg(F.sum(F.octet_length("key").cast("long") + 32)).first()[0] or 0
    if octets_ <= BROADCAST_BYTES:
        return suspects.join(F.broadcast(shared), "key")
    salted = suspects.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    return salted.join(shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "_salt"]).drop("_salt")


def line_dedup(docs: DataFrame, carry: tuple[str, ...] = (), min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop long lines that min_docs documents or more share, but for the largest id that holds them.

    Returns id_col, n_lines, n_dropped, text (the lines that stay, joined by \\n)
    and the carried columns, one row for each input row. A null or empty text is
    one empty line; a line's key is stripped of 0x20 and 0x09-0x0D and its A-Z
    are lowered; keys under min_chars code points always stay. Rows that repeat
    an id count as one document, and each gets the same result; a null id is the
    smallest; a null text comes back as the empty one. Texts and lines of any
    length are read whole. An empty table gives an empty table; other columns than
    those named, whatever they are called, are left out.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("_row", F.xxhash64("_id", "_text"))
    suspects = materialize(_suspects(rows.select("_id", "_row", "_text"), min_chars), "suspects")
    # the pairs of a key and a document are distinct but for rows that repeat an id: two steps, so that no key meets all its documents
    shared = suspects.groupBy("key", "_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"), F.max("_id").alias("last")).where(F.col("n") >= min_docs)
    drops = _meet(suspects, materialize(shared.select("key", "last"), "shared")).where(~F.col("_id").eqNullSafe(F.col("last")))
    drops = drops.groupBy("_id", "_row").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("_drop")).select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "_drop")
    joined = rows.join(drops, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left").drop("_id2", "_row2", "_row")
    extra = [joined.schema[f"_carry{i}"] for i in range(len(carry))]
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("_kept", T.StringType()), *extra])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, dropped, kept = [], [], []
            for t, d in zip(each(b, "_text"), column(b, "_drop"), strict=True):
                have = t.split("\n")
                gone = set(d or ())
                lines.append(len(have))
                dropped.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(have) if i not in gone) if gone else t)
            yield pa.record_batch([b.column("_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), *[b.column(f.name) for f in extra]], ["_id", "n_lines", "n_dropped", "_kept", *[f.name for f in extra]])

    out = joined.mapInArrow(keep, schema)
    return out.select(F.col("_id").alias(id_col), "n_lines", "n_dropped", F.col("_kept").alias(text_col), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)])
