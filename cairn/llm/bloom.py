"""Twin Bloom filters: which hashes were seen once, and which at least twice.

Each task fills its own pair; pairs meet block by block. A hash that lies in
two tasks' once-filters has all its bits in both, so

    twice |= twice_i | (once & once_i);  once |= once_i

keeps every hash seen twice anywhere. The merged twice-filter is a superset of
the repeated hashes: false suspects cost work later, never a result.

The filter has at most MAX_BITS bits (64 MB), whatever the input: this is the
proven bound of what the driver gathers and broadcasts. Beyond the input for
which it is sized, the share of false suspects rises and results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.text import U64, mix

MAX_BITS = 1 << 29
BLOCK = 1 << 13  # bytes of a block: the unit in which filters meet


def bits_for(elements: int, per_element: int) -> int:
    want = max(1 << 20, int(elements) * per_element)
    return min(MAX_BITS, 1 << (want - 1).bit_length())


def positions(h: np.ndarray, bits: int, k: int) -> Iterator[np.ndarray]:
    shift = U64(64 - (bits.bit_length() - 1))
    step = mix(h ^ U64(0xD6E8FEB86659FD93)) | U64(1)
    for i in range(k):
        yield (mix(h + step * U64(i)) >> shift).astype(np.int64)


def put(bitmap: np.ndarray, h: np.ndarray, k: int) -> None:
    for p in positions(h, len(bitmap) * 8, k):
        np.bitwise_or.at(bitmap, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))


def has(bitmap: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in positions(h, len(bitmap) * 8, k):
        found &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return found


class Twin:
    """One task's pair of filters."""

    def __init__(self, bits: int, k: int):
        self.once, self.twice, self.k = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), k

    def add(self, hashes: np.ndarray) -> None:
        """hashes: one for each sighting."""
        if not len(hashes):
            return
        h, n = np.unique(hashes, return_counts=True)
        again = (n > 1) | has(self.once, h, self.k)
        put(self.twice, h[again], self.k)
        put(self.once, h, self.k)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.once), BLOCK * 256):
            one = self.once[at : at + BLOCK * 256].reshape(-1, BLOCK)
            two = self.twice[at : at + BLOCK * 256].reshape(-1, BLOCK)
            used = np.flatnonzero(one.any(1))
            if len(used):
                yield pa.record_batch(
                    [
                        pa.array(used + at // BLOCK, pa.int64()),
                        pa.array([zlib.compress(one[i].tobytes(), 1) for i in used], pa.binary()),
                        pa.array([zlib.compress(two[i].tobytes(), 1) if two[i].any() else None for i in used], pa.binary()),
                    ],
                    ["block", "once", "twice"],
                )


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
    for a, b in zip(pdf["once"], pdf["twice"], strict=True):
        one = np.frombuffer(zlib.decompress(a), np.uint8)
        twice |= once & one
        if b is not None:
            twice |= np.frombuffer(zlib.decompress(b), np.uint8)
        once |= one
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "twice": [zlib.compress(twice.tobytes(), 1) if twice.any() else None]})


def seen_twice(df: DataFrame, sightings: Callable[[pa.RecordBatch], np.ndarray], bits: int, k: int) -> np.ndarray:
    """The merged twice-filter of all sightings, at most MAX_BITS bits, on the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            twin = Twin(bits, k)
            for b in batches:
                twin.add(sightings(b))
            yield from twin.blocks()

    met = df.mapInArrow(fill, "block long, once binary, twice binary").groupBy("block").applyInPandas(_meet, "block long, twice binary").where("twice is not null")
    out = np.zeros(bits // 8, np.uint8)
    for row in met.toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out
