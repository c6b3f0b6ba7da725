"""Vector spaces in which solvers run.

Solvers are written once, over vectors that add, subtract and scale, and a space
that applies operators and takes dot products.

FrameSpace: vectors are column expressions over one frame of indices, so sums
and scalings cost nothing; applying a matrix is one join and one sum; dot
products of a step are fused into one aggregate.  The matrix is written once, in
buckets by column, so a product moves the vector and partial sums, never the
matrix.  settle() writes the vectors that go on to the shared folder and deletes
the table they supersede.  For systems of any size.

LocalSpace: numpy in one task, for many small systems at once (one group a
system) and for coarse levels.

GatheredSpace: numpy vectors on the driver, the matrix a table of packed rows; for up
to GATHERED indices, where the jobs of a FrameSpace cost more than their work.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spmat import Packed, spmv
from ..session import bucketed, removed, written_at

#: Indices of a vector that the driver holds: 2 MB.
GATHERED = 1 << 18


class Operator(Protocol):
    """Anything that maps vectors to vectors of the same space."""

    def operate(self, v): ...


class CoefficientMatrix(Operator, Protocol):
    """An operator that also gives residuals."""

    def residual(self, b, x): ...


class Coefficients:
    """The matrix of a space as an operator, whatever the space and its precision."""

    def __init__(self, space: FrameSpace | LocalSpace):
        self.space = space

    def operate(self, v):
        return self.space.apply(v)

    def residual(self, b, x):
        return b - self.space.apply(x)


class FrameVector:
    """A column expression over the columns of its space's frame."""

    def __init__(self, space: FrameSpace, column: Column):
        self.space, self.column = space, column

    def _with(self, column: Column) -> FrameVector:
        return FrameVector(self.space, column)

    def __add__(self, other: FrameVector) -> FrameVector:
        return self._with(self.column + other.column)

    def __sub__(self, other: FrameVector) -> FrameVector:
        return self._with(self.column - other.column)

    def __rmul__(self, factor: float) -> FrameVector:
        return self._with(F.lit(float(factor)) * self.column)


class FrameSpace:
    """Vectors over the index domain (idx) as columns of one frame."""

    def __init__(self, a: DataFrame, domain: DataFrame):
        self.a = bucketed(a.select("row", "col", "val"), "col")
        self._table, self.frame = written_at(domain.select("idx"))
        self._n = 0
        self._given: list[str] = []
        self._cached: list[DataFrame] = []

    def _fresh(self) -> str:
        self._n += 1
        return f"v{self._n}"

    def vector(self, v: DataFrame) -> FrameVector:
        """A vector that is given from outside: settle() keeps it."""
        out = self._joined(v)
        self._given.append(f"v{self._n}")
        return out

    def _joined(self, v: DataFrame) -> FrameVector:
        name = self._fresh()
        # cached until settle(): if an executor is lost, it is computed again from the last table
        self.frame = self.frame.join(v.select("idx", F.col("val").alias(name)), "idx", "left").na.fill(0.0, [name]).persist()
        self._cached.append(self.frame)
        return FrameVector(self, F.col(name))

    def zeros(self) -> FrameVector:
        return FrameVector(self, F.lit(0.0))

    def frame_of(self, v: FrameVector) -> DataFrame:
        return self.frame.select("idx", v.column.alias("val"))

    def apply(self, v: FrameVector) -> FrameVector:
        return self.through(lambda x: spmv(self.a, x), v)

    def through(self, f: Callable[[DataFrame], DataFrame], v: FrameVector) -> FrameVector:
        """The result of a function of (idx, val) frames as a vector of this space."""
        return self._joined(f(self.frame_of(v)))

    def dots(self, *pairs: tuple[FrameVector, FrameVector]) -> list[float]:
        sums = [F.sum(p.column * q.column).alias(f"d{i}") for i, (p, q) in enumerate(pairs)]
        return [x if x is not None else 0.0 for x in self.frame.agg(*sums).first()]

    def settle(self, *vectors: FrameVector) -> list[FrameVector]:
        """The vectors as columns of a new, materialised frame, beside the given ones."""
        names = [self._fresh() for _ in vectors]
        superseded = self._table
        self._table, self.frame = written_at(self.frame.select("idx", *self._given, *[v.column.alias(n) for v, n in zip(vectors, names)]))
        for df in self._cached:
            df.unpersist()
        self._cached.clear()
        removed(self.frame.sparkSession, superseded)
        return [FrameVector(self, F.col(n)) for n in names]


class LocalSpace:
    """numpy vectors; values are rounded to ``kind`` after every operation."""

    def __init__(self, row, col, val, n: int, kind: type = np.float64, matrix_kind: type | None = None):
        self.n, self.kind = n, kind
        self.row, self.col = np.asarray(row), np.asarray(col)
        self.val = np.asarray(val, np.float64).astype(matrix_kind or kind)

    def vector(self, v) -> np.ndarray:
        return np.asarray(v).astype(self.kind)

    def zeros(self) -> np.ndarray:
        return np.zeros(self.n, self.kind)

    def apply(self, v: np.ndarray) -> np.ndarray:
        product = self.val * v[self.col]  # in the wider of the two kinds
        return np.bincount(self.row, product.astype(np.float64), self.n).astype(self.kind)

    def through(self, f: Callable[[np.ndarray], np.ndarray], v: np.ndarray) -> np.ndarray:
        return f(v).astype(self.kind)

    def dots(self, *pairs: tuple[np.ndarray, np.ndarray]) -> list[float]:
        return [float(np.dot(p.astype(np.float64), q.astype(np.float64))) for p, q in pairs]

    def settle(self, *vectors: np.ndarray) -> list[np.ndarray]:
        return [v.astype(self.kind) for v in vectors]


class GatheredSpace(LocalSpace):
    """Vectors over the index domain (idx) on the driver; a product is one job."""

    def __init__(self, a: DataFrame, domain: DataFrame):
        self.spark, self.kind = a.sparkSession, np.float64
        self.idx = np.unique(domain.select(F.col("idx").cast("long")).toArrow().column(0).to_numpy())
        self.n = len(self.idx)
        self.a = Packed(a, self.idx)

    def vector(self, v: DataFrame) -> np.ndarray:
        t = v.select(F.col("idx").cast("long").alias("idx"), F.col("val").cast("double").alias("val")).where("val is not null").toArrow()
        idx, out = t.column("idx").to_numpy(), np.zeros(self.n)
        known = np.isin(idx, self.idx)
        out[np.searchsorted(self.idx, idx[known])] = t.column("val").to_numpy()[known]
        return out

    def frame_of(self, v: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"idx": self.idx, "val": v}))

    def apply(self, v: np.ndarray) -> np.ndarray:
        return self.a(v)

    def through(self, f: Callable[[DataFrame], DataFrame], v: np.ndarray) -> np.ndarray:
        return self.vector(f(self.frame_of(v)))


def sized_space(a: DataFrame, domain: DataFrame, most: int = GATHERED) -> FrameSpace | GatheredSpace:
    """The space that suits the number of indices."""
    return (FrameSpace if domain.limit(most + 1).count() > most else GatheredSpace)(a, domain)
