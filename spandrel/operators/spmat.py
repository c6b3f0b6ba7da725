"""Sparse kernels on (row, col, val) frames: joins and grouped sums.

Every product is one equi-join and one sum that is begun map-side.  Results
over a row domain (a frame of idx) keep rows without entries, as zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def spmv(a: DataFrame, x: DataFrame, domain: DataFrame | None = None) -> DataFrame:
    """A x as (idx, val); with domain (idx), rows without entries are 0."""
    v = x.select(F.col("idx").alias("col"), F.col("val").alias("_x"))
    y = a.join(v, "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("val") * F.col("_x")).alias("val"))
    if domain is None:
        return y
    return domain.select("idx").join(y, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val"))


class Packed:
    """A matrix for many products with numpy vectors over the sorted indices ``idx``:
    written once by rows, a row's places and values as bytes in runs of ``run`` entries.
    A product is one job of one stage: the vector goes to the tasks, sums of runs come
    back.  Rows and columns outside idx do not count, as in a join."""

    def __init__(self, a: DataFrame, idx: np.ndarray, run: int = 512):
        self.n = len(idx)
        entries = a.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("val").cast("double")).where("val is not null")
        dealt = entries.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row").sortWithinPartitions("row")
        self.runs = written(dealt.mapInArrow(_packer(idx, run), "at int, places binary, vals binary"))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        sums = self.runs.mapInArrow(_multiplier(x), "at int, val double").toArrow()
        return np.bincount(sums.column("at").to_numpy(), sums.column("val").to_numpy(), self.n)


def _packer(idx: np.ndarray, run: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, col, val = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            i, j = (np.minimum(np.searchsorted(idx, k), len(idx) - 1) for k in (row, col))
            known = (idx[i] == row) & (idx[j] == col)
            i, j, val = i[known].astype(np.int32), j[known].astype(np.int32), val[known]
            if not len(i):
                continue
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            starts = np.flatnonzero((np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))) % run == 0)
            ends = np.r_[starts, len(i)].astype(np.int32)
            packed = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (j, val)]
            yield pa.RecordBatch.from_arrays([pa.array(i[starts]), *packed], ["at", "places", "vals"])

    return pack


def _flat(x: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, and where each begins."""
    x, size = x.cast(pa.large_binary()), np.dtype(kind).itemsize
    ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], kind, (ends[-1] - ends[0]) // size, ends[0]), (ends[:-1] - ends[0]) // size


def _multiplier(x: np.ndarray):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (places, starts), (vals, _) = _flat(b.column(1), np.int32), _flat(b.column(2), np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.add.reduceat(vals * x[places], starts))], ["at", "val"])

    return multiply


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """b - A x over the index of b."""
    ax = spmv(a, x).withColumnRenamed("val", "_ax")
    return b.join(ax, "idx", "left").select("idx", (F.col("val") - F.coalesce("_ax", F.lit(0.0))).alias("val"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B without entries that cancel to zero."""
    right = b.select(F.col("row").alias("_k"), F.col("col").alias("_j"), F.col("val").alias("_b"))
    c = a.join(right, a["col"] == right["_k"]).groupBy("row", "_j").agg(F.sum(F.col("val") * F.col("_b")).alias("val"))
    return c.where("val <> 0").select("row", F.col("_j").alias("col"), "val")


def galerkin(a: DataFrame, p: DataFrame) -> DataFrame:
    """P' A P."""
    return spgemm(transpose(p), spgemm(a, p))


def gram(b: DataFrame) -> DataFrame:
    """B' B."""
    return spgemm(transpose(b), b)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), *[c for c in a.columns if c not in ("row", "col")])


def conjugate_transpose(a: DataFrame) -> DataFrame:
    """A* for values that are structs of re and im."""
    return transpose(a).withColumn("val", F.struct(F.col("val.re").alias("re"), (-F.col("val.im")).alias("im")))


def pattern_transpose(a: DataFrame) -> DataFrame:
    """The transposed pattern with zero values."""
    return transpose(a).withColumn("val", F.lit(0.0))


def merged(a: DataFrame) -> DataFrame:
    """Entries that repeat are added up."""
    return a.groupBy("row", "col").agg(F.sum("val").alias("val"))


def sparse_dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum over the indices that both sparse vectors have; 0 if there are none."""
    both = x.join(y.select("idx", F.col("val").alias("_y")), "idx")
    return both.agg(F.coalesce(F.sum(F.col("val") * F.col("_y")), F.lit(0.0)).alias("val"))


def sparse_axpy(alpha: float, x: DataFrame, y: DataFrame, tol: float = 0.0) -> DataFrame:
    """alpha x + y on the union of indices; zeros and values below tol go."""
    both = x.select("idx", F.col("val").alias("_x")).join(y, "idx", "full_outer")
    total = F.lit(alpha) * F.coalesce("_x", F.lit(0.0)) + F.coalesce("val", F.lit(0.0))
    return both.select("idx", total.alias("val")).where((F.abs("val") >= tol) & (F.col("val") != 0))


def sparse_axpy_fill(alpha: float, x: DataFrame, y: DataFrame, tol: float, pivot: int) -> tuple[DataFrame, DataFrame]:
    """sparse_axpy, and the fill (idx, pivot): indices that y did not have."""
    z = sparse_axpy(alpha, x, y, tol)
    return z, z.join(y, "idx", "left_anti").select("idx", F.lit(pivot).cast("long").alias("pivot"))


# aggregates by row and column


def row_counts(a: DataFrame) -> DataFrame:
    return a.groupBy("row").agg(F.count(F.lit(1)).alias("n"))


def column_counts(a: DataFrame) -> DataFrame:
    return a.groupBy("col").agg(F.count(F.lit(1)).alias("n"))


def row_abs_max(a: DataFrame, off_diagonal: bool = False) -> DataFrame:
    rows = a.where("row <> col") if off_diagonal else a
    return rows.groupBy("row").agg(F.max(F.abs("val")).alias("val"))


def row_square_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("row").agg(F.sum(F.col("val") * F.col("val")).alias("val"))
