"""Files by their paths, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    """(file system, path) as the JVM has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists; raises if none does."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))
