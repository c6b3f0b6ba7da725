"""Matrices and vectors derived from Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pivoted(df: DataFrame, row: str, col: str, val: str) -> DataFrame:
    """The matrix of sums of val by (row, col)."""
    return df.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.sum(val).alias("val"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B before its sums: (row, col, val) of order, supplier and quantity, a row a line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val"))


def order_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: quantities by order and supplier."""
    return pivoted(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: quantities by part and supplier."""
    return pivoted(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


def supplier_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain (idx) of suppliers."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: (idx, j, val) of the embeddings, a dense matrix in long form."""
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("idx"), F.posexplode("embedding").alias("j", "val"))
    return d.withColumn("val", F.col("val").cast("double"))
