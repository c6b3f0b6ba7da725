"""Nested mixed-precision pipelines, one task a system.

A nested pipeline calls its innermost preconditioner m2 * m3 * m4 times for each
outer step, so it runs in numpy inside one grouped Arrow function: many systems
at once, one group a system, each bounded by the memory of a task.  Large single
systems use the solvers of krylov.py in a FrameSpace.

Precisions: an inner level's vectors are cast to its kind where they enter and
back where they leave; half-precision values are rounded after every operation.
Factors and approximate inverses are kept in the inner kind, as sparse rows, and
substitution runs in its arithmetic, level by level.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels as K
from .krylov import CG, FGMRES, AdaptiveRichardson, BiCGStab, Restarted, Richardson, relative
from .report import FIELDS
from .spaces import LocalSpace

KINDS = {"double": np.float64, "float": np.float32, "half": np.float16}
#: By name: (kind of the outer vectors, then (steps, kind of vectors, kind of matrix) a level).
DEPTHS = {
    "f2": [(64, "float", "float")], "f2h": [(64, "half", "half")],
    "f3": [(8, "float", "float"), (8, "float", "half")], "f3h": [(8, "float", "float"), (8, "half", "half")],
    "f4": [(8, "float", "float"), (4, "float", "half"), (2, "half", "half")],
}


@dataclass
class Config:
    """A pipeline's parameters.  method: f3r, static, cg, bicgstab, gmres, or a name in
    DEPTHS; precision: that of the inner levels and factors."""

    method: str = "f3r"
    precision: str = "double"
    m2: int = 8
    m3: int = 4
    m4: int = 2
    period: int = 64
    omega: float = 1.0
    acc: float = 1.0
    blocks: int = 4
    restart: int = 3
    outer: int = 100
    tol: float = 1e-8
    preconditioner: str = "bjilu0"


def symmetric_scaling(row, col, val, n: int) -> np.ndarray:
    """The entries of the symmetrically scaled matrix.  Neither right-hand side nor
    solution is transformed: the scaled system is the one that is solved."""
    d = np.zeros(n)
    np.add.at(d, row[row == col], val[row == col])
    s = np.sqrt(np.where(d == 0, 1.0, np.abs(d)))
    return val / (s[row] * s[col])


class Triangle:
    """A triangular matrix in compressed rows, its values rounded to a kind.  Rows are
    put into levels, each of rows that depend on earlier levels only, so solving is
    a few vectorised steps a level, in the kind's arithmetic."""

    def __init__(self, row, col, val, n: int, kind: type, unit: bool):
        off = row != col
        self.kind, self.unit = kind, unit
        self.diagonal = np.ones(n, kind)
        if not unit:
            self.diagonal[row[~off]] = val[~off].astype(kind)
        order = np.argsort(row[off], kind="stable")
        row, self.col, self.val = row[off][order], col[off][order], val[off][order].astype(kind)
        begin = np.searchsorted(row, np.arange(n + 1))
        lower = not len(row) or bool((self.col < row).all())
        depth = np.zeros(n, np.int64)
        for i in range(n) if lower else range(n - 1, -1, -1):
            if begin[i] < begin[i + 1]:
                depth[i] = depth[self.col[begin[i] : begin[i + 1]]].max() + 1
        self.levels = []
        for level in range(1, int(depth.max(initial=0)) + 1):
            rows = np.flatnonzero(depth == level)
            sizes = begin[rows + 1] - begin[rows]
            starts = np.cumsum(sizes) - sizes
            self.levels.append((rows, np.repeat(begin[rows] - starts, sizes) + np.arange(sizes.sum()), starts))
        self.first = np.flatnonzero(depth == 0)

    def solve(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(self.kind)
        if not self.unit:
            x[self.first] /= self.diagonal[self.first]
        for rows, at, starts in self.levels:
            left = x[rows] - np.add.reduceat(self.val[at] * x[self.col[at]], starts)
            x[rows] = left if self.unit else left / self.diagonal[rows]
        return x


def block_factors(row, col, val, n: int, blocks: int, acc: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the incomplete LU factors of the diagonal blocks, L below the diagonal."""
    size = -(-n // blocks)
    out = []
    for lo in range(0, n, size):
        inside = (row >= lo) & (row < lo + size) & (col >= lo) & (col < lo + size)
        out.append([np.array(x) for x in K.entries(K.ilu(K.rows_of(row[inside].tolist(), col[inside].tolist(), val[inside].tolist()), 0, acc))])
    i, j, v = (np.concatenate(x) for x in zip(*out))
    return i, j, v


class TriangularPair:
    """U^-1 L^-1 of block factors, kept and solved in a kind."""

    def __init__(self, row, col, val, n: int, blocks: int, acc: float, kind: type):
        i, j, v = block_factors(row, col, val, n, blocks, acc)
        self.lower = Triangle(i[j <= i], j[j <= i], v[j <= i], n, kind, True)
        self.upper = Triangle(i[j >= i], j[j >= i], v[j >= i], n, kind, False)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return self.upper.solve(self.lower.solve(v))


class InversePair:
    """Z (W v) of the approximate inverse, both kept and multiplied in a kind."""

    def __init__(self, row, col, val, n: int, tol: float, acc: float, kind: type):
        z, w, d = K.approximate_inverse(K.rows_of(row.tolist(), col.tolist(), val.tolist()), tol, acc)
        column, at, value = (np.array(x) for x in K.entries(z))
        self.z = LocalSpace(at, column, value / np.array([d[i] for i in column.tolist()]), n, kind)
        self.w = LocalSpace(*(np.array(x) for x in K.entries(w)), n, kind)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return self.z.apply(self.w.apply(v.astype(self.w.kind)))


def _entered(f: Callable[[np.ndarray], np.ndarray], kind: type) -> Callable[[np.ndarray], np.ndarray]:
    """f in another precision: cast in, cast back out."""
    return lambda v: f(v.astype(kind)).astype(v.dtype)


def pipeline(row, col, val, n: int, c: Config):
    """The outer solver of a configuration, and the number of preconditioner calls for
    each of its steps."""
    space = lambda vectors, matrix: LocalSpace(row, col, val, n, KINDS[vectors], KINDS[matrix])
    inner = KINDS[c.precision]
    if c.preconditioner == "bjilu0":
        m = TriangularPair(row, col, val, n, c.blocks, c.acc, inner)
    else:
        m = InversePair(row, col, val, n, 0.1, c.acc, inner)
    outer = space("double", "double")
    if c.method in ("cg", "bicgstab", "gmres"):
        m = _entered(m, inner)
        if c.method == "gmres":
            return Restarted(FGMRES(outer, m, 64), 300), 1
        return (CG if c.method == "cg" else BiCGStab)(outer, m, 19200), 1 if c.method == "cg" else 2
    if c.method in DEPTHS:
        levels, calls = DEPTHS[c.method], 1
        for steps, vectors, matrix in reversed(levels):
            s = space(vectors, matrix)
            m = FGMRES(s, _entered(m, KINDS[vectors]), steps).operate
            calls *= steps
        return Restarted(FGMRES(outer, _entered(m, KINDS[levels[0][1]]), c.outer), c.restart), calls
    # outer double; m2 and m3 levels at least single; innermost in the precision asked for
    middle = "double" if c.precision == "double" else "float"
    deep = space(c.precision, c.precision)
    smooth = AdaptiveRichardson(deep, m, c.m4, c.period) if c.method == "f3r" else Richardson(deep, m, c.m4, c.omega)
    third = FGMRES(space(middle, c.precision), _entered(smooth.operate, inner), c.m3)
    second = FGMRES(space(middle, middle), third.operate, c.m2)
    return Restarted(FGMRES(outer, _entered(second.operate, KINDS[middle]), c.outer), c.restart), c.m2 * c.m3 * c.m4


def factors(a: DataFrame, blocks: int = 4, precision: str = "half", acc: float = 1.0) -> DataFrame:
    """(system, row, col, val) of the block factors of the scaled systems of
    (system, row, col, val), values rounded to the precision they are kept in."""

    def run(t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        n = int(row.max()) + 1
        i, j, v = block_factors(row, col, symmetric_scaling(row, col, t.column("val").to_numpy(), n), n, blocks, acc)
        return pa.table({"system": [t.column("system")[0].as_py()] * len(i), "row": i, "col": j, "val": v.astype(KINDS[precision]).astype(np.float64)})

    return a.select("system", "row", "col", "val").groupBy("system").applyInArrow(run, "system string, row long, col long, val double")


METRICS = "system string, repetition int, solved boolean, iters long, seconds double, implicit double, explicit double"


def run_systems(a: DataFrame, b: DataFrame, config: Config, repetitions: int = 1) -> DataFrame:
    """One row a system and repetition of what solving it took: METRICS.  Every
    repetition begins with a new solver, so learnt weights are those of one run."""

    def run(t: pa.Table, rhs: pa.Table) -> pa.Table:
        out = []
        for k in range(repetitions):
            system = System(t, rhs)
            began = time.perf_counter()
            x, result, calls, _ = system.solve(config)
            out.append((system.name, k, bool(result.solved), int(result.iters * calls), time.perf_counter() - began, result.res / system.norm, system.explicit(x)))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], [c.split()[0] for c in METRICS.split(", ")])

    return _by_system(a, b, run, METRICS)


def report_rows(metrics: DataFrame, config: Config) -> DataFrame:
    """Result rows (report.FIELDS) of METRICS: means over the repetitions, the largest
    residuals, and the parameters of the configuration."""
    krylov, adaptive = config.method in ("cg", "bicgstab", "gmres"), config.method == "f3r"
    names = {"f3r": "F3R", "static": "F3R-Static", "cg": "CG", "bicgstab": "BiCGStab", "gmres": "GMRES"}
    nested = config.method in ("f3r", "static")
    lit = lambda v, kind: F.lit(v).cast(kind)
    parameters = {
        "Method": lit(names.get(config.method, config.method.upper()), "string"),
        "Prec": lit({"half": "_Float16"}.get(config.precision, config.precision), "string"),
        "M2": lit(config.m2 * nested, "long"), "M3": lit(config.m3 * nested, "long"), "M4": lit(config.m4 * nested, "long"),
        "W": lit(float(config.period) if adaptive else 0.0 if krylov or not nested else config.omega, "double"),
        "Precond": lit(config.preconditioner.upper(), "string"), "ACC": lit(config.acc, "double"),
    }
    rows = metrics.groupBy(F.col("system").alias("Problem")).agg(
        F.avg("seconds").alias("Time"), F.expr("sum(iters) div count(*)").alias("Iter"), F.max("implicit").alias("ImplRes"), F.max("explicit").alias("ExplRes")
    )
    return rows.withColumns(parameters).select(*FIELDS)


def convergence(a: DataFrame, b: DataFrame, config: Config) -> DataFrame:
    """(system, step, relres): the outer solver's relative residual after each step,
    those of later cycles numbered on; step 0 is the first guess."""

    def run(t: pa.Table, rhs: pa.Table) -> pa.Table:
        system = System(t, rhs)
        _, _, _, solver = system.solve(config)
        history = (solver.inner if isinstance(solver, Restarted) else solver).history
        # a cycle begins with the residual that the one before it ended with
        steps = [norm for n, (k, norm) in enumerate(history) if k or not n]
        return pa.table({"system": [system.name] * len(steps), "step": pa.array(range(len(steps)), pa.int32()), "relres": [x / system.norm for x in steps]})

    return _by_system(a, b, run, "system string, step int, relres double")


class System:
    """One system in a task: symmetrically scaled entries and the right-hand side."""

    def __init__(self, t: pa.Table, rhs: pa.Table, scaled: bool = True):
        self.row, self.col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        self.val, self.n, self.name = t.column("val").to_numpy().astype(np.float64), rhs.num_rows, rhs.column("system")[0].as_py()
        self.b = np.zeros(self.n)
        self.b[rhs.column("idx").to_numpy()] = rhs.column("val").to_numpy()
        if scaled:
            self.val = symmetric_scaling(self.row, self.col, self.val, self.n)
        self.norm = float(np.linalg.norm(self.b))

    def solve(self, config: Config):
        """Solution, SolveResult, preconditioner calls a step, and the solver."""
        solver, calls = pipeline(self.row, self.col, self.val, self.n, config)
        x, result = solver.solve(self.b, None, relative(self.norm, config.tol))
        return x, result, calls, solver

    def explicit(self, x: np.ndarray) -> float:
        return float(np.linalg.norm(self.b - np.bincount(self.row, self.val * x[self.col], self.n))) / self.norm


def _by_system(a: DataFrame, b: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    left = a.select("system", "row", "col", "val").groupBy("system")
    return left.cogroup(b.select("system", "idx", "val").groupBy("system")).applyInArrow(run, schema)


SCHEMA = "system string, idx long, x double, solved boolean, iters long, implicit double, explicit double"


def solve_systems(a: DataFrame, b: DataFrame, config: Config, scaled: bool = True) -> DataFrame:
    """Solves every system of a (system, row, col, val) and b (system, idx, val):
    (system, idx, x, solved, iters, implicit and explicit relative residuals)."""

    def run(t: pa.Table, rhs: pa.Table) -> pa.Table:
        system = System(t, rhs, scaled)
        x, result, calls, _ = system.solve(config)
        same = lambda value: [value] * system.n
        return pa.table({
            "system": same(system.name), "idx": np.arange(system.n), "x": x, "solved": same(bool(result.solved)),
            "iters": same(int(result.iters * calls)), "implicit": same(result.res / system.norm), "explicit": same(system.explicit(x)),
        })

    return _by_system(a, b, run, SCHEMA)
