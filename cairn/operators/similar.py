"""Pairs of like vectors without meeting all blocks: pivots and the triangle inequality on the sphere.

Angles between directions are a metric. Every vector belongs to the cell of its
nearest pivot; a cell's radius is its widest angle. If two vectors lie within the
angle t of each other, then either lies within t plus the radius of the other's
pivot: so a vector visits just the cells whose pivot is that near, and every pair
is found in the cell of its smaller id. Clustered vectors visit a few cells;
vectors without structure visit all, which is seen beforehand from the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

#: Pivots at most: their vectors are collected and sent to tasks (8 MB at 256 components).
PIVOTS = 4096
EDGE = 1e-6  # angles of rounded products


def units(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("vec")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


@dataclass
class Cells:
    """Vectors (id, vec, dims) of one length by cell, with the counts that say what their meeting costs."""

    homes: DataFrame  # id, vec, cell
    visits: DataFrame  # id, vec, cell
    sizes: dict[int, tuple[int, int]]  # cell: homes, visitors
    least: float

    @staticmethod
    def of(v: DataFrame, n: int, least: float) -> Cells | None:
        """None where lengths differ, or no pivot can be had: then blocks meet."""
        if v.agg(F.min("dims") == F.max("dims")).first()[0] is not True:
            return None
        v = v.where(F.exists("vec", lambda x: x != 0)).select("id", "vec")  # a zero vector is like none
        most = min(PIVOTS, max(16, 2 * math.isqrt(n)))
        chosen = [r[0] for r in v.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").collect()]
        if not chosen:
            return None
        spark, kind = v.sparkSession, v.schema["id"].dataType.simpleString()
        p = np.array(chosen)
        shared = spark.sparkContext.broadcast(p / np.linalg.norm(p, axis=1, keepdims=True))

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    b = whole.slice(lo, 1024)
                    a = angles(units(b), shared.value)
                    at = a.argmin(1)
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(a[np.arange(len(at)), at])], ["id", "vec", "cell", "angle"])

        homes = materialize(v.mapInArrow(settle, f"id {kind}, vec array<double>, cell int, angle double"), "cells")
        radius = np.full(len(p), -10.0)
        count = dict.fromkeys(range(len(p)), 0)
        for r in homes.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # a row a pivot
            radius[r["cell"]], count[r["cell"]] = r["r"], r["n"]
        reach = radius + math.acos(max(-1.0, min(1.0, least - 6e-5))) + EDGE

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    b = whole.slice(lo, 256)
                    row, cell = np.nonzero(angles(units(b), shared.value) <= reach)
                    at = pa.array(row, pa.int64())
                    yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(cell, pa.int32())], ["id", "vec", "cell"])

        visits = homes.select("id", "vec").mapInArrow(visit, f"id {kind}, vec array<double>, cell int")

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(reach), np.int64)
            for b in batches:
                seen += (angles(units(b), shared.value) <= reach).sum(0)
            yield pa.record_batch([pa.array(np.arange(len(seen)), pa.int32()), pa.array(seen)], ["cell", "n"])

        seen = {r["cell"]: r["n"] for r in homes.select("id", "vec").mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        return Cells(homes.select("id", "vec", "cell"), visits, {c: (n, seen[c]) for c, n in count.items() if n}, least)

    def products(self) -> int:
        """How many pairs of vectors meet."""
        return sum(h * v for h, v in self.sizes.values())

    def pairs(self, block: int) -> DataFrame:
        """(a, b, confidence): pairs over the threshold, each once. A cell's homes and visitors meet in blocks, so that no task has a whole cell."""
        spark, kind, least = self.homes.sparkSession, self.homes.schema["id"].dataType.simpleString(), self.least
        shape = F.broadcast(spark.createDataFrame([(c, -(-h // block), -(-v // (8 * block))) for c, (h, v) in self.sizes.items()], "cell int, hs int, vs int"))

        def deal(x: DataFrame, own: str, n: str, other: str, others: str) -> DataFrame:
            x = x.join(shape, "cell")
            return x.select("cell", "id", "vec", F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))

        def meet(hs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
            if not len(hs) or not len(vs):
                return pd.DataFrame({"a": hs["id"][:0], "b": hs["id"][:0], "confidence": np.zeros(0)})
            x, y = np.array(hs["vec"].tolist()), np.array(vs["vec"].tolist())
            s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
            p, q = np.nonzero(s >= least - 6e-5)
            a, b = hs["id"].to_numpy()[p], vs["id"].to_numpy()[q]
            keep = a < b
            return pd.DataFrame({"a": a[keep], "b": b[keep], "confidence": s[p, q][keep]})

        keys = ["cell", "i", "j"]
        left, right = deal(self.homes, "i", "hs", "j", "vs").groupBy(*keys), deal(self.visits, "j", "vs", "i", "hs").groupBy(*keys)
        return left.cogroup(right).applyInPandas(meet, f"a {kind}, b {kind}, confidence double")
