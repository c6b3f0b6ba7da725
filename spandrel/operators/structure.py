"""Filters, splits, scalings and permutations of (row, col, val) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(idx: Column, n: int, blocks: int, unit: int = 1) -> Column:
    """The block of an index: blocks of ceil(units / blocks) units; the last takes
    the rest."""
    size = -(-(n // unit) // blocks) * unit
    return F.least(F.floor(idx / size), F.lit(blocks - 1)).cast("long")


def block_diagonal(a: DataFrame, n: int, blocks: int, unit: int = 1) -> DataFrame:
    """Entries within diagonal blocks, with the block."""
    row, col = block_of(F.col("row"), n, blocks, unit), block_of(F.col("col"), n, blocks, unit)
    return a.withColumn("block", row).where(F.col("block") == col)


def partition_diagonal(a: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries whose row and column are in one part of parts (idx, part)."""
    p = parts.select(F.col("idx").alias("row"), F.col("part").alias("_p"))
    q = parts.select(F.col("idx").alias("col"), F.col("part").alias("_q"))
    return a.join(p, "row").join(q, "col").where("_p = _q").select("row", "col", "val")


def lower_unit(a: DataFrame) -> DataFrame:
    """The lower triangle with ones on the diagonal."""
    return a.where("col <= row").withColumn("val", F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.col("val")))


def upper(a: DataFrame) -> DataFrame:
    return a.where("col >= row")


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("row = col").groupBy(F.col("row").alias("idx")).agg(F.sum("val").alias("val"))


def inverted_diagonal(a: DataFrame) -> DataFrame:
    """A with 1 / d in place of its diagonal entries."""
    return a.withColumn("val", F.when(F.col("row") == F.col("col"), F.lit(1.0) / F.when(F.col("row") == F.col("col"), F.col("val")).otherwise(1.0)).otherwise(F.col("val")))


def rotated(a: DataFrame, n: int) -> DataFrame:
    """(i, j) to (n - 1 - i, n - 1 - j)."""
    return a.select((F.lit(n - 1) - F.col("row")).alias("row"), (F.lit(n - 1) - F.col("col")).alias("col"), "val")


def scaled_symmetric(a: DataFrame) -> DataFrame:
    """a_ij / (sqrt|a_ii| sqrt|a_jj|); a missing or zero diagonal counts as 1."""
    d = a.where("row = col and val <> 0").select(F.col("row").alias("_i"), F.sqrt(F.abs("val")).alias("_d"))
    r, c = d.select(F.col("_i").alias("row"), F.col("_d").alias("_r")), d.select(F.col("_i").alias("col"), F.col("_d").alias("_c"))
    scaled = F.col("val") / (F.coalesce("_r", F.lit(1.0)) * F.coalesce("_c", F.lit(1.0)))
    return a.join(r, "row", "left").join(c, "col", "left").select("row", "col", scaled.alias("val"))


def scaled_rows(a: DataFrame) -> DataFrame:
    """a_ij / max_j |a_ij|; a row of zeros stays."""
    most = a.groupBy("row").agg(F.max(F.abs("val")).alias("_m"))
    return a.join(most, "row").select("row", "col", (F.col("val") / F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m"))).alias("val"))


def strong_weak(a: DataFrame, theta: float = 0.6) -> DataFrame:
    """A with ``strong``: off the diagonal and at least theta times the largest
    off-diagonal of its row; the rest, the diagonal included, is weak."""
    most = a.where("row <> col").groupBy("row").agg(F.max(F.abs("val")).alias("_m"))
    strong = (F.col("row") != F.col("col")) & (F.abs("val") >= theta * F.col("_m"))
    return a.join(most, "row", "left").select("row", "col", "val", F.coalesce(strong, F.lit(False)).alias("strong"))


def by_coarseness(strong: DataFrame, coarse: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries whose column is in coarse (idx), and the others."""
    c = coarse.select(F.col("idx").alias("col"))
    return strong.join(c, "col", "left_semi").select("row", "col", "val"), strong.join(c, "col", "left_anti").select("row", "col", "val")


# permutations (new, old): position new takes what old had


def permuted_rows(a: DataFrame, pi: DataFrame) -> DataFrame:
    return a.join(pi, a["row"] == pi["old"]).select(F.col("new").alias("row"), "col", "val")


def permuted_columns(a: DataFrame, pi: DataFrame) -> DataFrame:
    """Column j becomes pi[j]."""
    return a.join(pi, a["col"] == pi["new"]).select("row", F.col("old").alias("col"), "val")


def permuted_vector(v: DataFrame, pi: DataFrame) -> DataFrame:
    return v.join(pi, v["idx"] == pi["old"]).select(F.col("new").alias("idx"), "val")


def inverse(pi: DataFrame) -> DataFrame:
    return pi.select(F.col("old").alias("new"), F.col("new").alias("old"))


def reordered(a: DataFrame, pi: DataFrame, b: DataFrame | None = None):
    """P A P' (and P b), and the inverse permutation."""
    pap = permuted_columns(permuted_rows(a, pi), inverse(pi))
    return pap, None if b is None else permuted_vector(b, pi), inverse(pi)


def ordered_by(keys: DataFrame, key: str = "color", size: int = 1 << 16) -> DataFrame:
    """The permutation that sorts indices by (key, idx), of (idx, key) rows.  Indices
    are numbered within runs of ``size`` of a key and shifted by the runs' sizes;
    the only global window runs over one row a run."""
    runs = keys.withColumn("_run", F.floor(F.col("idx") / size))
    sizes = runs.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(key, "_run").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy(key, "_run").orderBy("idx")) - 1
    return runs.withColumn("_r", rank).join(shifts, [key, "_run"]).select((F.col("_s") + F.col("_r")).cast("long").alias("new"), F.col("idx").alias("old"))
