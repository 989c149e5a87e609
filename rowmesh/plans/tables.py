"""Matrices and samples that the star-schema tables stand for.

L: rows are orders, columns are parts, values are quantities. S: the symmetric
matrix of part and supplier numbers, lower triangle stored. E: samples, a matrix
for each user, a variant for each kind of event, with views as the baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE = "view"
#: Variants of E in their order, each with the chunk size and the thread number that it stands for.
VARIANTS = {"click": (1, 1), "error": (2, 2), "purchase": (5, 4), "signup": (10, 8)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit("L").alias("matrix"), F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))


def rows_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lit("L").alias("matrix"), F.col("o_orderkey").alias("i"))


def columns_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("L").alias("matrix"), F.col("p_partkey").alias("j"), F.col("p_size").cast("double").alias("x"))


def matrix_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.lit("S").alias("matrix"), F.greatest(a, b).alias("i"), F.least(a, b).alias("j"), F.col("l_quantity").alias("v"))


def samples_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("matrix"), F.col("event_type").alias("variant"), F.col("value").alias("ms"), "event_id", "ts")


def by_variant(which: int) -> Column:
    """The chunk size (0) or thread number (1) of E's variant; null for the baseline."""
    found = F
    for name, numbers in VARIANTS.items():
        found = found.when(F.col("variant") == name, numbers[which])
    return found


def ordinal() -> Column:
    found = F
    for k, name in enumerate(VARIANTS):
        found = found.when(F.col("variant") == name, k + 1)
    return found
