"""A persisted vector index of concepts: embedded once, brought up to date by what changed, searched exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import hooks
from cairn.operators import retrieval as R
from cairn.session import materialize
from cairn.sources.collection import Collection

SCHEMA = "name string, digest string, vec array<float>, definition string, chapter string, node_role string, difficulty int"
Model = Callable[[list[str]], np.ndarray]


class VectorStore:
    """Concepts by name with the vector of their document, in a stored collection at a path."""

    def __init__(self, spark: SparkSession, path: str, model: Model, buckets: int = 64):
        self.rows, self.model = Collection(spark, path, SCHEMA, "name", buckets), model

    def update(self, concepts: DataFrame) -> int:
        """Embed the concepts whose document is new or changed, and store those whose other fields changed; returns how many were embedded.

        Concepts that are not given stay as they are. Of rows that repeat a name the
        last by document counts.
        """
        docs = R.concept_document(concepts).withColumn("digest", F.sha2("document", 256)).join(R.concept_metadata(concepts), "name")
        docs = materialize(docs.dropDuplicates(["name", "digest", "definition", "chapter", "node_role", "difficulty"]), "documents")
        have = self.rows.read().select("name", "digest", F.col("vec").alias("_vec"), F.xxhash64("definition", "chapter", "node_role", "difficulty").alias("_was"))
        met = docs.join(have, ["name", "digest"], "left").withColumn("_is", F.xxhash64("definition", "chapter", "node_role", "difficulty"))
        ask = materialize(met.where("_vec IS NULL").select("name", "digest", "document", "definition", "chapter", "node_role", "difficulty"), "unembedded")
        vecs = materialize(hooks.embed(ask.select(F.struct("name", "digest").alias("id"), F.col("document").alias("text")), self.model), "vectors")
        new = ask.drop("document").join(vecs.select("id.name", "id.digest", "vec"), ["name", "digest"])
        kept = met.where("_vec IS NOT NULL AND _is <> _was").select("name", "digest", "definition", "chapter", "node_role", "difficulty", F.col("_vec").alias("vec"))
        self.rows.upsert(new.unionByName(kept), ["digest"])
        return ask.count()

    def search(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(query, rank, name, definition, score): the k nearest concepts of each question. questions: (id, text)."""
        held = self.rows.read()
        asked = materialize(hooks.embed(questions, self.model), "questions")
        near = R.top_k(asked, held.select(F.col("name").alias("id"), "vec"), k)
        return near.withColumnRenamed("id", "name").join(held.select("name", "definition"), "name").select("query", "rank", "name", "definition", "score")
