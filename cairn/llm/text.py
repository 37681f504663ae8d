"""Words, hashes and Arrow plumbing that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
EMPTY = np.zeros(0, U64)
#: Characters that part words: 0x20 and 0x09 to 0x0D, as bytes.split() has them.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def words(text: str | None) -> list[bytes]:
    """Maximal runs without 0x20 and 0x09-0x0D; a null text has none."""
    return text.encode().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), U64, len(ws))


def word_hashes_wide(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit lanes of each word's 128-bit hash."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, ws)), U64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def ngrams(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Order-sensitive hash of each k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return EMPTY
    out = np.zeros(n, U64)
    for j, c in enumerate(constants(k, seed)):
        out += h[j : j + n] * c
    return mix(out)


def occurrence_labelled(shingles: np.ndarray) -> np.ndarray:
    """Make repeated shingles distinct: the i-th copy of a value gets the label i."""
    n = len(shingles)
    if n < 2:
        return shingles
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return shingles
    at = np.arange(n)
    copy = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty(n, U64)
    out[order] = np.where(copy > 0, mix(s + copy.astype(U64) * U64(0x9E3779B97F4A7C15)), s)
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of each run of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return first, np.r_[first[1:], len(x)]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def each(batch: pa.RecordBatch, name: str) -> Iterator:
    """A column's values one by one: long texts of a batch are not all held a second time."""
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(name)))


def text_of(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def octets(docs: DataFrame, name: str = "text") -> int:
    """Bytes of all texts; only sizes filters by it, no result depends on it."""
    return int(docs.agg(F.sum(F.octet_length(F.col(name)).cast("long"))).first()[0] or 0)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: inside a lambda an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), 0)
