"""Keep-first and keep-last by an explicit order: never by where a row happens to lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import SPREAD, materialize


def numbered(df: DataFrame, keys: list[str | Column], order: list[str | Column], name: str = "_rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    return numbered(df, keys, order).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: list[str | Column], order: list[str | Column], n: int) -> DataFrame:
    return numbered(df, keys, order).where(F.col("_rn") <= n).drop("_rn")


def numbered_over_all(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Rows numbered from 1 in a global order: sorted by ranges, numbered within each, and moved up by the ranges before it."""
    ranges = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    # a row a range
    sizes, before, starts = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect(), 0, []
    for r in sizes:
        starts.append((r["p"], before))
        before += r["n"]
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _start long"))
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(start, part == F.col("_p")).withColumn(name, F.col("_start") + within + 1).drop("_m", "_p", "_start")
