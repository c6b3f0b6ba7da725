"""Generated matrices and vectors: no input, any size, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stencil27(spark: SparkSession, nx: int, ny: int, nz: int, beta: float = 0.0) -> DataFrame:
    """The 27-point stencil on a grid: 26 on the diagonal, -1 for the neighbours,
    cut off at the boundary.  beta makes it nonsymmetric along z: -1 - beta for the
    neighbour below, -1 + beta for the one above."""
    points = spark.range(nx * ny * nz).select(F.col("id").alias("row"), F.expr(f"id % {nx}").alias("x"), F.expr(f"id div {nx} % {ny}").alias("y"), F.expr(f"id div {nx * ny}").alias("z"))
    near = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(26))).alias("k"))
    near = near.withColumn("dx", F.expr("k % 3 - 1")).withColumn("dy", F.expr("k div 3 % 3 - 1")).withColumn("dz", F.expr("k div 9 - 1"))
    inside = F.expr(f"x + dx between 0 and {nx - 1} and y + dy between 0 and {ny - 1} and z + dz between 0 and {nz - 1}")
    face = F.expr("dx = 0 and dy = 0")
    val = F.when(face & F.expr("dz = 0"), 26.0).when(face & F.expr("dz = -1"), -1.0 - beta).when(face & F.expr("dz = 1"), -1.0 + beta).otherwise(-1.0)
    return near.where(inside).select("row", F.expr(f"row + dx + {nx} * dy + {nx * ny} * dz").alias("col"), val.alias("val"))


def hpcg(spark: SparkSession, n: int) -> DataFrame:
    return stencil27(spark, n, n, n)


def hpgmp(spark: SparkSession, n: int, beta: float = 0.5) -> DataFrame:
    return stencil27(spark, n, n, n, beta)


def grid_of(exponents: str) -> tuple[int, int, int]:
    """Grid sizes of a problem name's exponents, as 7_7_7 for 128 x 128 x 128."""
    x, y, z = (1 << int(e) for e in exponents.split("_"))
    return x, y, z


def iota(spark: SparkSession, n: int, offset: float = 0.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") + F.lit(offset)).cast("double").alias("val"))


def filled(spark: SparkSession, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(float(value)).alias("val"))


def pseudo_random(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """Values in [low, high) that depend on index and seed only: a multiplicative
    hash in integer arithmetic, so any engine can make the same ones."""
    h = F.expr(f"((id + {seed}) % 1000003 * 7919 + 104729) % 1000003")
    return spark.range(n).select(F.col("id").alias("idx"), (F.lit(low) + (high - low) * h / F.lit(1000003.0)).alias("val"))
