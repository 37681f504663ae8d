"""Language and embedding models as injected clients, called in tasks.

A client is any picklable callable; calls.py says how it is called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import calls
from cairn.session import materialize

def complete_json(prompts: DataFrame, call: calls.Client, schema: str, **how) -> DataFrame:
    """As calls.complete(), with the value parsed by a schema."""
    return calls.parsed(calls.complete(prompts, call, **how), schema)


def hashed_embedding(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: hashed character trigrams, normalised."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for r, t in enumerate(texts):
            for i in range(max(1, len(t) - 2)):
                h = hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest()
                out[r, int.from_bytes(h[:4], "little") % dims] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(out[r])
            out[r] /= n if n else 1
        return out

    return embed


def embed(texts: DataFrame, model: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """texts: (id, text). Returns (id, vec), the model called with up to `batch` texts at a time."""
    kind = texts.schema["id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [x or "" for x in b.column(1).to_pylist()]
            v = [row.tolist() for i in range(0, len(t), batch) for row in model(t[i : i + batch])]
            yield pa.record_batch([b.column(0), pa.array(v, pa.list_(pa.float32()))], ["id", "vec"])

    return texts.select("id", "text").mapInArrow(go, f"id {kind}, vec array<float>")


def review(batches: DataFrame, call: calls.Client | calls.Asker) -> DataFrame:
    """Reviewer's decisions on candidate pairs, a call a batch; an answer of another length is no merge for all of them.

    batches: (batch, p_ord, name_a, name_b). Returns (p_ord, name_a, name_b, merge, canonical, reason).
    """
    pair = F.struct("p_ord", "name_a", "name_b")
    asked = materialize(batches.groupBy("batch").agg(F.array_sort(F.collect_list(pair)).alias("pairs")), "batches")
    prompt = F.to_json(F.transform("pairs", lambda p: F.struct(p["name_a"].alias("name_a"), p["name_b"].alias("name_b"))))
    said = calls.asking(call)(asked.select(F.col("batch").alias("id"), prompt.alias("prompt")))
    verdicts = F.from_json("value", "array<struct<merge boolean, canonical string, reason string>>")
    rows = asked.join(said.select(F.col("id").alias("batch"), verdicts.alias("verdicts")), "batch", "left")
    whole = F.when(F.size("verdicts") == F.size("pairs"), F.col("verdicts"))
    each = rows.select("pairs", whole.alias("verdicts")).select(F.posexplode("pairs").alias("at", "p"), "verdicts").withColumn("v", F.get("verdicts", F.col("at")))
    return each.select("p.*", F.coalesce("v.merge", F.lit(False)).alias("merge"), "v.canonical", "v.reason")
