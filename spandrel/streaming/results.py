"""Result files that arrive in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.report import _LONGS, _TEXTS, FIELDS, parsed_number


def stream_results(spark: SparkSession, folder: str) -> DataFrame:
    """Typed result rows of every CSV file that comes to the folder."""
    raw = spark.readStream.schema(", ".join(f"{c} string" for c in FIELDS)).option("header", True).csv(folder)
    return raw.select(*[F.trim(F.col(c)).alias(c) if c in _TEXTS else F.col(c).try_cast("long").alias(c) if c in _LONGS else parsed_number(F.col(c)).alias(c) for c in FIELDS])


def running_means(results: DataFrame) -> DataFrame:
    """Mean time and whole mean iterations by problem and method, as rows arrive: state
    of one row for each (problem, method, precision)."""
    return results.groupBy("Problem", "Method", "Prec").agg(F.avg("Time").alias("Time"), F.expr("sum(Iter) div count(*)").alias("Iter"), F.count(F.lit(1)).alias("runs"))
