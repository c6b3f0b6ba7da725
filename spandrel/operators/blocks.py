"""Kernels applied to the blocks of a frame, one group a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import kernels as K


def _rows(t: pa.Table) -> K.Rows:
    return K.rows_of(*(t.column(c).to_pylist() for c in ("row", "col", "val")))


def _table(rows: K.Rows, block: int) -> pa.Table:
    i, j, v = K.entries(rows)
    return pa.table({"block": pa.array([block] * len(i), pa.int64()), "row": pa.array(i, pa.int64()), "col": pa.array(j, pa.int64()), "val": pa.array(v, pa.float64())})


def per_block(a: DataFrame, kernel: Callable[[K.Rows], K.Rows]) -> DataFrame:
    """(block, row, col, val): kernel applied to the rows of each block of
    (block, row, col, val)."""

    def run(t: pa.Table) -> pa.Table:
        return _table(kernel(_rows(t)), t.column("block")[0].as_py())

    return a.select("block", "row", "col", "val").groupBy("block").applyInArrow(run, "block long, row long, col long, val double")


def ilu0(a: DataFrame, acc: float = 1.0) -> DataFrame:
    return per_block(a, lambda r: K.ilu(r, 0, acc))


def ilup(a: DataFrame, level: int, acc: float = 1.0) -> DataFrame:
    return per_block(a, lambda r: K.ilu(r, level, acc))


def ilu_tiles(a: DataFrame, height: int, width: int, acc: float = 1.0) -> DataFrame:
    """Incomplete LU on the pattern of dense tiles: a block's entries are spread to
    whole tiles, zeros included, within the block."""

    def kernel(rows: K.Rows) -> K.Rows:
        known = set(rows)
        tiles = {(i // height, j // width) for i, r in rows.items() for j in r}
        full = {i: {} for i in rows}
        for bi, bj in tiles:
            for i in range(bi * height, (bi + 1) * height):
                for j in range(bj * width, (bj + 1) * width):
                    if i in known and j in known:
                        full[i][j] = rows[i].get(j, 0.0)
        return K.ilu(full, 0, acc)

    return per_block(a, kernel)


def _solved(factor: DataFrame, b: DataFrame, solve: Callable[[K.Rows, dict[int, float]], dict[int, float]]) -> DataFrame:
    def run(t: pa.Table, rhs: pa.Table) -> pa.Table:
        x = solve(_rows(t), dict(zip(rhs.column("idx").to_pylist(), rhs.column("val").to_pylist())))
        return pa.table({"idx": pa.array(list(x), pa.int64()), "val": pa.array(list(x.values()), pa.float64())})

    left = factor.select("block", "row", "col", "val").groupBy("block")
    return left.cogroup(b.select("block", "idx", "val").groupBy("block")).applyInArrow(run, "idx long, val double")


def solve_lower(factor: DataFrame, b: DataFrame, unit: bool = True) -> DataFrame:
    """L^-1 b, block by block, of (block, row, col, val) and (block, idx, val)."""
    return _solved(factor, b, lambda rows, v: K.solve_lower(rows, v, unit))


def solve_upper(factor: DataFrame, b: DataFrame) -> DataFrame:
    return _solved(factor, b, K.solve_upper)


def solve_ilu(factor: DataFrame, b: DataFrame) -> DataFrame:
    """U^-1 L^-1 b in one pass over the blocks."""
    return _solved(factor, b, lambda rows, v: K.solve_upper(rows, K.solve_lower(rows, v)))


def solve_tiles(tiles: DataFrame, b: DataFrame, height: int, width: int, lower: bool = True, unit: bool = False) -> DataFrame:
    """L^-1 b (or U^-1 b) of dense tiles (block, brow, bcol, vals) and (block, idx, val),
    block by block; a block's indices are a run, and tiles across two blocks'
    rows do not occur."""

    def run(t: pa.Table, rhs: pa.Table) -> pa.Table:
        cells = {(i, j): np.array(v).reshape(width, height).T for i, j, v in zip(*(t.column(c).to_pylist() for c in ("brow", "bcol", "vals")))}
        x = K.solve_tiles(cells, dict(zip(rhs.column("idx").to_pylist(), rhs.column("val").to_pylist())), height, width, lower, unit)
        return pa.table({"idx": pa.array(list(x), pa.int64()), "val": pa.array(list(x.values()), pa.float64())})

    left = tiles.select("block", "brow", "bcol", "vals").groupBy("block")
    return left.cogroup(b.select("block", "idx", "val").groupBy("block")).applyInArrow(run, "idx long, val double")


def connected_parts(a: DataFrame, fold: int = 1 << 19) -> DataFrame:
    """(idx, part) of indices with entries off the diagonal: the smallest index that each
    is connected to in its block, for blocks without a common index.  Tasks fold
    their entries to one link an index, so a block's group has links, not entries."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for b in batches:
            kept.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
            size += b.num_rows
            if size > fold:
                kept = [folded(np.concatenate(kept, axis=1))]
                size = 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in folded(np.concatenate(kept, axis=1))], ["block", "idx", "part"])

    def folded(x: np.ndarray) -> np.ndarray:
        block, u, v = x
        nodes, part = K.least_linked(u, v)
        of = np.empty(len(nodes), np.int64)
        of[np.searchsorted(nodes, u)] = block
        of[np.searchsorted(nodes, v)] = block
        return np.stack([of, nodes, part])

    def joined(t: pa.Table) -> pa.Table:
        nodes, part = K.least_linked(t.column("idx").to_numpy(), t.column("part").to_numpy())
        return pa.table({"idx": nodes, "part": part})

    pairs = a.select(*(F.col(c).cast("long") for c in ("block", "row", "col"))).where("row <> col")
    return pairs.mapInArrow(links, "block long, idx long, part long").groupBy("block").applyInArrow(joined, "idx long, part long")


def inverse_entries(row: np.ndarray, col: np.ndarray, val: np.ndarray, tol: float = 0.1, acc: float = 1.0, follow_fill: bool = False) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of Z D^-1 ('z', vectors as columns) and W' ('w', vectors as rows) of one
    part's approximate inverse."""
    n = len(np.unique(row))
    if tol == 0 and (n <= 2048 or n * n <= 16 * len(row)):
        nodes, z, w, d = K.whole_inverse(row, col, val, acc, follow_fill)
        out = []
        for name, x in (("z", z), ("w", w)):
            i, k = np.nonzero(x)
            out.append((name, nodes[k], nodes[i], x[i, k] / d[i]) if name == "z" else (name, nodes[i], nodes[k], x[i, k]))
        return out
    z, w, d = K.approximate_inverse(K.rows_of(row.tolist(), col.tolist(), val.tolist()), tol, acc, follow_fill)
    i, k, v = (np.array(c) for c in K.entries(z))
    return [("z", k, i, v / np.array([d[x] for x in i.tolist()])), ("w", *(np.array(c) for c in K.entries(w)))]


#: Indices of a part that a task inverts whole, beside a second task of its executor.
WHOLE = 3072


def inverse_in_place(row: np.ndarray, col: np.ndarray, val: np.ndarray, follow_fill: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Z W r for r over places 0 to n - 1, without dropping; up to WHOLE indices by the
    dense panels themselves, whose entries in lists would be four times as large."""
    if len(np.unique(row)) <= WHOLE:
        nodes, z, w, d = K.whole_inverse(row, col, val, 1.0, follow_fill)
        at, panels = (lambda r: r[nodes]), (lambda r: z.T @ ((w @ r) / d))
    else:
        (_, zi, zk, zv), (_, wi, wk, wv) = inverse_entries(row, col, val, 0.0, 1.0, follow_fill)
        nodes = slice(None)
        at, panels = (lambda r: r), (lambda r: np.bincount(zi, zv * np.bincount(wi, wv * r[wk], len(r))[zk], len(r)))

    def apply(r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r))
        out[nodes] = panels(at(r))
        return out

    return apply


def approximate_inverse(a: DataFrame, tol: float = 0.1, acc: float = 1.0, follow_fill: bool = False) -> DataFrame:
    """(factor, row, col, val) of blocks: factor 'z' is Z D^-1 with vectors as columns,
    'w' is W' with vectors as rows, so the inverse is about z w.  Vectors of connected
    parts of a block do not meet, so parts are worked on in parallel."""

    def run(t: pa.Table) -> pa.Table:
        part, row, col, val = (t.column(c).to_numpy() for c in ("part", "row", "col", "val"))
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        found = [f for own in np.split(order, cuts) for f in inverse_entries(row[own], col[own], val[own], tol, acc, follow_fill)]
        names = pa.chunked_array([pa.repeat(pa.scalar(name), len(i)) for name, i, _, _ in found])
        return pa.table({"factor": names} | {c: np.concatenate([f[k] for f in found]) for k, c in ((1, "row"), (2, "col"), (3, "val"))})

    cells = written(a.select(*(F.col(c).cast("long") for c in ("block", "row", "col")), F.col("val").cast("double")))
    parts = connected_parts(cells).withColumnRenamed("idx", "row")
    share = F.pmod(F.xxhash64("part"), F.lit(4 * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = cells.join(parts, "row", "left").withColumn("part", F.coalesce("part", "row")).select("block", share.alias("share"), "part", "row", "col", "val")
    return placed.groupBy("block", "share").applyInArrow(run, "factor string, row long, col long, val double")


def graph_labels(edges: DataFrame, label: Callable[[dict[int, set[int]]], dict[int, int]], name: str, nodes: DataFrame | None = None, most: int = 5_000_000) -> DataFrame:
    """(idx, name) by a sequential kernel over the whole graph (src, dst), in one task.
    These kernels are defined by index order; ``most`` bounds the edges they take,
    beyond it the caller must cut the graph into blocks."""
    pairs = edges.select("src", "dst")
    if nodes is not None:
        pairs = pairs.unionByName(nodes.select(F.col("idx").alias("src"), F.col("idx").alias("dst")))

    def run(t: pa.Table) -> pa.Table:
        if t.num_rows > most:
            raise ValueError(f"{t.num_rows} edges; a sequential kernel takes {most}")
        out = label(K.adjacency(t.column("src").to_pylist(), t.column("dst").to_pylist()))
        return pa.table({"idx": pa.array(list(out), pa.int64()), name: pa.array(list(out.values()), pa.int64())})

    return pairs.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(run, f"idx long, {name} long")
