"""Table schemas and the fixed values of the graph model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
EDGE_TYPES = ("PREREQUISITE", "PART_OF", "RELATED", "SOLVES", "TESTS", "CONFUSABLE")
UNDIRECTED = ("RELATED", "CONFUSABLE")
NODE_ROLES = ("概念", "机制", "算法", "问题")
DEFAULT_ROLE = "概念"
ALGORITHM = "算法"
SOLVES_ROLES = ("算法", "机制")
DEFAULT_EDGE_TYPES = ("PREREQUISITE", "RELATED", "SOLVES")
WEAK_SIGNALS = ("有助于", "有帮助", "有关系", "相关", "对比", "加深理解", "可以帮助", "有所了解")
# Tenths of a weakness point by depth, and what a right answer takes off.
WEIGHT_TENTHS = {0: 10, 1: 7, 2: 5}
FAR_WEIGHT_TENTHS, CORRECT_TENTHS = 3, 5
RISKS = ("high", "medium", "low", "unknown")
HIGH_BELOW, MEDIUM_BELOW, WEAK_BELOW = 0.4, 0.7, 0.6
MAX_HOPS, MAX_ITEMS = 5, 10

CONCEPT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("difficulty", T.IntegerType()),
        T.StructField("node_role", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("preemptive", T.BooleanType()),
        T.StructField("starvation_free", T.BooleanType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("scenario", T.StringType()),
    ]
)
PROBLEM = T.StructType([T.StructField(c, T.StringType()) for c in ("pid", "stem", "answer", "type", "chapter")])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "source", "target", "description", "chapter", "dimensions")] + [T.StructField("reviewed", T.BooleanType())])
CHUNK = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "source", "chapter", "text")])
QUESTION = T.StructType(
    [T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("hops", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("type", T.StringType())]
)
EVALUATION = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "ground_truth", "predicted")] + [T.StructField("correct", T.BooleanType()), T.StructField("reason", T.StringType())])
KNOWLEDGE_BASE = (
    "concepts array<struct<name string, sources array<string>, occurrence_count int, total_weight double, category string, category_name string, category_color string, meta_class string>>,"
    "relations array<struct<subject string, relation string, object string>>,"
    "chapters array<struct<number int, title string, pages string, topics array<string>>>,"
    "formulas array<struct<name string, text string, type string, source string, latex string, meaning string>>"
)
