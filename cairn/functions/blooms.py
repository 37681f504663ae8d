"""A Bloom filter of 64-bit hashes, built by an aggregation and asked by arrays in tasks. Its size is bounded, whatever the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 32 MB: what the driver gathers and tasks are sent. Beyond it more is let through, and nothing is lost.
MAX_BITS = 1 << 28
PER_KEY, HASHES, ROW_BITS = 12, 4, 32768
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def build(keys: DataFrame) -> np.ndarray:
    """The filter of a column h (long, any values)."""
    n = keys.count()
    bits = min(MAX_BITS, max(ROW_BITS, 1 << (max(1, n * PER_KEY) - 1).bit_length()))
    h = F.col("h")
    # halves of 32 bits times constants of 30: no sum leaves 63 bits
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    at = [(F.shiftrightunsigned(low * F.lit(m >> 2) + high * F.lit((m >> 2) ^ 0x0545F490), 11)).bitwiseAND(F.lit(bits - 1)) for m in _ODD]
    rows = keys.select(F.explode(F.array(*at)).alias("at")).groupBy(F.shiftright("at", 15).alias("row")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(ROW_BITS - 1))).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["row"] * (ROW_BITS // 8) : (r["row"] + 1) * (ROW_BITS // 8)] = np.frombuffer(r["b"], np.uint8)
    return out


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) may be in the filter."""
    u = h.astype(np.int64).view(np.uint64)
    high, low = u >> np.uint64(32), u & np.uint64(0xFFFFFFFF)
    found = np.ones(len(u), bool)
    for m in _ODD:
        at = ((low * np.uint64(m >> 2) + high * np.uint64((m >> 2) ^ 0x0545F490)) >> np.uint64(11)) & np.uint64(len(bitmap) * 8 - 1)
        found &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
