"""The graph model over the synthetic tables: parts are concepts, orders are problems, line items test parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    role = F.when(F.col("p_type") == "SMALL", "机制").when(F.col("p_type") == "ECONOMY", "算法").when(F.col("p_type") == "PROMO", "问题").otherwise("概念")
    return p.select(
        key("P", F.col("p_partkey")).alias("name"),
        F.array("p_name").alias("aliases"),
        F.concat("p_name", F.lit(" "), "p_type").alias("definition"),
        F.col("p_brand").alias("chapter"),
        (1 + F.col("p_size") % 3).cast("int").alias("difficulty"),
        role.alias("node_role"),
        F.col("p_partkey").alias("ord"),
    )


def prereq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    half = p.where("k >= 1").select(key("P", F.floor(F.col("k") / 2)).alias("source"), key("P", F.col("k")).alias("target"), (2 * F.col("k")).alias("ord"))
    third = p.where("k >= 5 and k % 5 = 0").select(key("P", F.floor(F.col("k") / 3)).alias("source"), key("P", F.col("k")).alias("target"), (2 * F.col("k") + 1).alias("ord"))
    return half.unionByName(third)


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ord"))
    return li.select(key("O", F.col("l_orderkey")).alias("source"), key("P", F.col("l_partkey")).alias("target"), "ord")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("learner"), key("O", F.col("o_orderkey")).alias("pid"), (F.col("o_orderstatus") == "F").alias("wrong"), (F.col("o_orderstatus") == "O").alias("correct"))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_partkey")
    a, b = li.select("l_orderkey", F.col("l_partkey").alias("a")), li.select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = a.join(b, "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.select(key("P", F.col("a")).alias("source"), key("P", F.col("b")).alias("target"), "n")


def part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    low = p.groupBy("p_brand").agg(F.min("p_partkey").alias("m"))
    return p.join(low, "p_brand").where("p_partkey <> m").select(key("P", F.col("p_partkey")).alias("source"), key("P", F.col("m")).alias("target"))


def solves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_type").isin("SMALL", "ECONOMY") & (F.col("p_partkey") >= 1))
    return p.select(key("P", F.col("p_partkey")).alias("source"), key("P", F.floor(F.col("p_partkey") / 4)).alias("target"), F.col("p_partkey").alias("ord"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as an extractor would give them: self-loops, wrong roles and repeats among them.

    `ord` is a sortable key of the line item rather than a global row number, so
    that no task has to number all rows.
    """
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "PREREQUISITE").when(F.col("l_returnflag") == "R", "SOLVES").otherwise("RELATED")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(key("P", F.col("l_partkey")).alias("source"), key("P", F.col("l_suppkey")).alias("target"), kind.alias("type"), F.col("l_linestatus").alias("description"), order.alias("ord"))


def edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(source, target, type, description, ord) of the named edge types."""
    made = {
        "PREREQUISITE": lambda: prereq(spark, sf_dir).withColumn("ord", F.col("ord").cast("long")),
        "TESTS": lambda: tests(spark, sf_dir).withColumn("ord", F.col("ord").cast("long")),
        "SOLVES": lambda: solves(spark, sf_dir).withColumn("ord", F.col("ord").cast("long")),
        "RELATED": lambda: related(spark, sf_dir).withColumn("ord", F.col("n").cast("long")),
        "PART_OF": lambda: part_of(spark, sf_dir).withColumn("ord", F.lit(0).cast("long")),
    }
    out = None
    for k in kinds or tuple(made):
        one = made[k]().select("source", "target", F.lit(k).alias("type"), F.lit("").alias("description"), "ord")
        out = one if out is None else out.unionByName(one)
    return out


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms with an order: the benchmark passages."""
    b = table(spark, sf_dir, "benchmark").where("text is not null and text <> ''")
    return b.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("canonical"), F.col("text").alias("term"), F.col("item_id").alias("ord"))
