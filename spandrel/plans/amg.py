"""Algebraic multigrid with classical coarsening.

Strength, interpolation and Galerkin products are joins and sums.  Coarse points
are chosen one after another in one task, and in parallel rounds where the strong
pattern is larger than a task should take.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators.spmat import galerkin, residual, spmv, transpose
from ..operators.structure import by_coarseness, strong_weak
from ..session import written
from .precond import smoother, spai0

THETA = 0.6


def coarse_points(strong: DataFrame, domain: DataFrame, most: int = 5_000_000) -> DataFrame:
    """(idx, coarse) of the domain, from strong entries (row, col).  ``most`` bounds the
    strong entries and points that the sequential choice takes together; beyond it
    the choice is that of coarse_points_parallel."""
    if strong.count() + domain.count() > most:
        return coarse_points_parallel(strong, domain)

    def run(t: pa.Table) -> pa.Table:
        strong_of: dict[int, set[int]] = {}
        for i, j in zip(t.column("row").to_pylist(), t.column("col").to_pylist()):
            strong_of.setdefault(i, set())
            if j is not None:
                strong_of[i].add(j)
        chosen = K.coarse_points(strong_of)
        nodes = sorted(strong_of)
        return pa.table({"idx": pa.array(nodes, pa.int64()), "coarse": pa.array([n in chosen for n in nodes])})

    rows = strong.select("row", "col").unionByName(domain.select(F.col("idx").alias("row"), F.lit(None).cast("long").alias("col")))
    return rows.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(run, "idx long, coarse boolean")


def coarse_points_parallel(strong: DataFrame, domain: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(idx, coarse) in rounds, for patterns of any size: a free point on which more
    points depend than on its free neighbours (ties by a hash) becomes coarse, and
    the free points that depend on it fine.  Points on which none depends are fine.
    At last, of two fine points that depend on each other without a common coarse
    point, the first is made coarse.  A choice like the sequential one, not equal."""
    edges = written(strong.where("row <> col").select("row", "col").distinct())
    near = written(edges.union(edges.select("col", "row")).distinct())
    weight = edges.groupBy(F.col("col").alias("idx")).agg(F.count(F.lit(1)).alias("w"))
    state = domain.select("idx").distinct().join(weight, "idx", "left").select("idx", F.coalesce("w", F.lit(0)).alias("w"))
    # coarse: true, false, or null while the point is free
    state = written(state.select("idx", F.struct("w", F.xxhash64("idx").alias("h"), "idx").alias("key"), F.when(F.col("w") == 0, F.lit(False)).alias("coarse")))
    for _ in range(most_rounds):
        others = state.where("coarse is null").select(F.col("idx").alias("col"), F.col("key").alias("_k"))
        top = near.join(others, "col").groupBy(F.col("row").alias("idx")).agg(F.max("_k").alias("top"))
        first = F.col("coarse").isNull() & (F.col("top").isNull() | (F.col("key") > F.col("top")))
        chosen = state.join(top, "idx", "left").select("idx", "key", F.when(first, True).otherwise(F.col("coarse")).alias("coarse"))
        chosen = written(chosen)
        bound = edges.join(chosen.where("coarse").select(F.col("idx").alias("col")), "col").select(F.col("row").alias("idx"), F.lit(True).alias("_b")).distinct()
        state = written(chosen.join(bound, "idx", "left").select("idx", "key", F.when(F.col("coarse").isNull() & F.col("_b"), False).otherwise(F.col("coarse")).alias("coarse")))
        if state.where("coarse is null").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("the choice of coarse points did not end")
    fine, coarse = (state.where(c).select(F.col("idx").alias("_p")) for c in ("not coarse", "coarse"))
    pairs = edges.where("col > row").join(fine, edges["row"] == fine["_p"]).drop("_p")
    pairs = written(pairs.join(fine, pairs["col"] == fine["_p"]).drop("_p"))
    to = written(edges.join(coarse, edges["col"] == coarse["_p"]).select("row", F.col("col").alias("c")))
    common = pairs.join(to, "row").join(to.select(F.col("row").alias("col"), "c"), ["col", "c"]).select("row", "col").distinct()
    more = pairs.join(common, ["row", "col"], "left_anti").select(F.col("row").alias("idx"), F.lit(True).alias("_m")).distinct()
    return state.join(more, "idx", "left").select("idx", F.coalesce("_m", F.col("coarse")).alias("coarse"))


def interpolation(a: DataFrame, points: DataFrame, theta: float = THETA) -> DataFrame:
    """(row, col, val) over the points' own numbers: coarse rows are the identity; a
    fine row i puts on a coarse point j the weight
    -(a_ij + sum over strong fine m of a_im a_mj / sum over coarse k of a_mk) / (weak
    entries of i, the diagonal included), where j and k are strong coarse points of
    i.  A fine neighbour that shares no coarse point counts as weak."""
    parts = strong_weak(a, theta)
    coarse = points.where("coarse").select("idx")
    fine = points.where("not coarse").select(F.col("idx").alias("row"))
    to_coarse, to_fine = by_coarseness(parts.where("strong"), coarse)
    c, f = to_coarse.join(fine, "row", "left_semi"), to_fine.join(fine, "row", "left_semi")
    # for fine i, strong fine m: a_mj at the strong coarse points j of i
    target = c.select(F.col("row").alias("i"), F.col("col").alias("j"))
    through = f.select(F.col("row").alias("i"), F.col("col").alias("m"), F.col("val").alias("a_im"))
    am = a.select(F.col("row").alias("m"), F.col("col").alias("j"), F.col("val").alias("a_mj"))
    paths = through.join(am, "m").join(target, ["i", "j"])
    sums = paths.groupBy("i", "m").agg(F.sum("a_mj").alias("s")).where("s <> 0")
    shared = paths.join(sums, ["i", "m"]).groupBy("i", "j").agg(F.sum(F.col("a_im") * F.col("a_mj") / F.col("s")).alias("t"))
    lone = through.join(sums, ["i", "m"], "left_anti").groupBy(F.col("i").alias("row")).agg(F.sum("a_im").alias("lone"))
    weak = parts.where("not strong").join(fine, "row", "left_semi").groupBy("row").agg(F.sum("val").alias("weak"))
    weak = weak.join(lone, "row", "left").select(F.col("row").alias("i"), (F.col("weak") + F.coalesce("lone", F.lit(0.0))).alias("weak"))
    direct = c.select(F.col("row").alias("i"), F.col("col").alias("j"), F.col("val").alias("a_ij"))
    weights = direct.join(shared, ["i", "j"], "left").join(weak, "i")
    value = -(F.col("a_ij") + F.coalesce("t", F.lit(0.0))) / F.when(F.col("weak") != 0, F.col("weak"))
    rows = weights.select(F.col("i").alias("row"), F.col("j").alias("col"), F.coalesce(value, F.lit(0.0)).alias("val"))
    return rows.unionByName(coarse.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(1.0).alias("val")))


class AMG:
    """V-cycles over a hierarchy of Galerkin products.  Levels keep the finest level's
    numbers for their points, so no renumbering is needed.

    coarsest(level, points) says which level is solved densely: by default one of at
    most 200 points, or the tenth.  smoothers make a level's smoother (b, x) to x
    from its matrix; level l takes the one at l modulo their number.  coarsen
    chooses points from strong entries and the domain."""

    def __init__(self, a: DataFrame, domain: DataFrame, theta: float = THETA, smallest: int = 200, most: int = 10, steps: int = 1, coarsest: Callable[[int, int], bool] | None = None, smoothers: Sequence[Callable[[DataFrame], Callable]] = (), coarsen: Callable[[DataFrame, DataFrame], DataFrame] = coarse_points):
        self.levels = []
        stop = coarsest or (lambda level, points: points <= smallest or level + 1 >= most)
        pack = list(smoothers) or [lambda m: smoother(m, spai0(m), steps)]
        a, domain = written(a), written(domain.select("idx"))
        while True:
            n = domain.count()
            if stop(len(self.levels), n):
                break
            points = written(coarsen(strong_weak(a, theta).where("strong"), domain))
            m = points.where("coarse").count()
            if m == 0 or m == n:
                break
            p = written(interpolation(a, points, theta))
            self.levels.append((a, p, pack[len(self.levels) % len(pack)](a), domain))
            a, domain = written(galerkin(a, p)), written(points.where("coarse").select("idx"))
        if n > 5000:
            raise ValueError(f"coarsest level has {n} points")
        self.domain = domain
        rows, idx = a.toArrow(), np.sort(domain.toArrow().column("idx").to_numpy())
        dense = np.zeros((n, n))
        at = lambda c: np.searchsorted(idx, rows.column(c).to_numpy())
        np.add.at(dense, (at("row"), at("col")), rows.column("val").to_numpy())
        self.idx, self.inverse = idx, np.linalg.pinv(dense)

    def _coarsest(self, b: DataFrame) -> DataFrame:
        t = b.toArrow()  # 5000 rows at most
        v = np.zeros(len(self.idx))
        v[np.searchsorted(self.idx, t.column("idx").to_numpy())] = t.column("val").to_numpy()
        return b.sparkSession.createDataFrame(pa.table({"idx": self.idx, "val": self.inverse @ v}))

    def cycle(self, b: DataFrame, level: int = 0) -> DataFrame:
        if level == len(self.levels):
            return self._coarsest(b)
        a, p, smooth, domain = self.levels[level]
        x = smooth(b, domain.select("idx", F.lit(0.0).alias("val")))
        coarse = self.cycle(written(spmv(transpose(p), residual(a, x, b))), level + 1)
        fix = spmv(p, coarse).withColumnRenamed("val", "_c")
        x = written(x.join(fix, "idx", "left").select("idx", (F.col("val") + F.coalesce("_c", F.lit(0.0))).alias("val")))
        return smooth(b, x)

    def __call__(self, r: DataFrame) -> DataFrame:
        return self.cycle(r)
