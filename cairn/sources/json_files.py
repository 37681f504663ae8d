"""The tables that JSON files hold. `ord` is an element's place in its file: the order that keep-first refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import schema as S
from cairn.functions.scalar import strip
from cairn.sources.files import exists, first_existing
from cairn.sources.frames import keep_first
from cairn.sources.json_array import read_array, write_array  # noqa: F401


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, S.CONCEPT)


def read_problems(spark: SparkSession, *paths: str) -> DataFrame:
    return read_array(spark, first_existing(spark, *paths), S.PROBLEM)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, S.EDGE)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, S.CHUNK, missing_ok=True)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, S.QUESTION)


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.KNOWLEDGE_BASE).json(path, multiLine=True)


def read_evaluation(spark: SparkSession, path: str, methods: tuple[str, ...] = ("vector_rag", "graph_rag")) -> DataFrame:
    """(method, question, ground_truth, predicted, correct, reason), a row a judged question; empty if there is no file."""
    one = T.StructType([T.StructField("accuracy", T.DoubleType()), T.StructField("details", T.ArrayType(S.EVALUATION))])
    schema = T.StructType([T.StructField(m, one) for m in methods])
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("method", T.StringType()), *S.EVALUATION.fields]))
    raw = spark.read.schema(schema).json(path, multiLine=True)
    parts = [raw.select(F.lit(m).alias("method"), F.explode(f"{m}.details").alias("d")).select("method", "d.*") for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_defaults(concepts: DataFrame) -> DataFrame:
    """Missing attributes as readers see them: role 概念, difficulty 1, empty definition and chapter."""
    return concepts.withColumns(
        {"definition": F.coalesce("definition", F.lit("")), "chapter": F.coalesce("chapter", F.lit("")), "difficulty": F.coalesce("difficulty", F.lit(1)), "node_role": F.coalesce("node_role", F.lit(S.DEFAULT_ROLE)), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))}
    )


def terms(concepts: DataFrame) -> DataFrame:
    """(term, canonical, ord): each name and each alias once. A name beats an alias; among aliases the first comes first."""
    names = concepts.select(F.col("name").alias("term"), F.col("name").alias("canonical"), F.lit(0).alias("kind"), "ord", F.lit(0).alias("at"))
    alias = concepts.select(F.posexplode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("at", "term"), F.col("name").alias("canonical"), "ord")
    alias = alias.select(strip(F.col("term")).alias("term"), "canonical", F.lit(1).alias("kind"), "ord", "at").where("term <> ''")
    return keep_first(names.unionByName(alias), ["term"], ["kind", "ord", "at"]).select("term", "canonical", "kind", "ord", "at")


def search_terms(concepts: DataFrame) -> DataFrame:
    """(canonical, term): every distinct name or alias of each concept, for containment search."""
    both = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts.select(F.col("name").alias("canonical"), F.explode(both).alias("term")).where("term <> ''").distinct()


def merge_incremental(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, then new ones, the first of each key."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, list(keys), ["_src", "ord"]).drop("_src")


def append_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks whose chunk_id is not there yet; equal ids within the new ones all come in."""
    return existing.unionByName(new.join(existing.select("chunk_id").distinct(), "chunk_id", "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keep the last row of each key: target first, then rows, by `ord`."""
    both = target.withColumn("_src", F.lit(0)).unionByName(rows.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [key], [F.desc("_src"), F.desc("ord")]).drop("_src")
