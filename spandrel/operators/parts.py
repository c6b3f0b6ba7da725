"""Gram matrices by connected parts: one task makes the whole matrix of a part and works
on it.  Entries travel packed, as bytes, and never as rows of the matrix."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import kernels as K

#: (place in idx, row, col, val) of a part, rows and columns counted within it, to a value a place.
OnPart = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


#: Entries of B that a task packs, and cells of parts that a task has, as far as parts allow.
ENTRIES, CELLS = 1 << 19, 1 << 20

#: The same of a unit to a batch.
OnUnit = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


class GramParts:
    """B' B over the sorted indices ``idx`` for a B that is written packed, dealt by rows,
    and the part of each place: the smallest that it is connected to.  Entries of B that
    repeat are added up; columns outside idx do not count.

    Each task writes one label an index, and few tasks join them to parts for the driver.
    What a task holds does not depend on the number of shuffle partitions: with few of
    them there are more tasks."""

    def __init__(self, b: DataFrame, idx: np.ndarray, piece: int = 1 << 16):
        self.spark, self.idx = b.sparkSession, idx
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entries = b.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("val").cast("double")).where("row is not null and col is not null and val is not null")
        dealt = entries.repartition(max(self.tasks, -(-b.count() // ENTRIES)), "row").mapInArrow(_by_rows(idx, piece), "nodes binary, parts binary, starts binary, places binary, vals binary")
        packed = written(dealt)
        labels = packed.select("nodes", "parts").where("nodes is not null").coalesce(8).mapInArrow(_joined(len(idx)), "nodes binary, parts binary").toArrow()
        self.part = _linked(len(idx), labels.column("nodes"), labels.column("parts"))
        self.packed = packed.select("starts", "places", "vals").where("starts is not null")

    def sizes(self) -> np.ndarray:
        """The size of each place's part."""
        return np.bincount(self.part, minlength=len(self.idx))[self.part]

    def per_unit(self, unit: np.ndarray, work: OnUnit, schema: str, fold: int = 1 << 20) -> DataFrame:
        """work applied to the matrix of each unit: places of one part with the same number
        in ``unit``; places with a negative one are left out.  Tasks send sums of at most
        ``fold`` products, of cells up to the diagonal, to the task of their unit."""
        own = np.flatnonzero(unit >= 0)
        cells = float((np.unique(unit[own], return_counts=True)[1].astype(float) ** 2).sum())
        share = _shares(unit[own], max(self.tasks, int(-(-cells // CELLS))))
        by = np.lexsort((unit[own], share))  # by share, unit and index
        order, bounds = own[by], np.searchsorted(share[by], np.arange(share.max(initial=0) + 2))
        place = np.zeros(len(unit), np.int64)
        place[order] = np.arange(len(order))
        whole = None if np.array_equal(unit, self.part) else unit
        sums = self.packed.mapInArrow(_products(place, whole, bounds, fold), "share int, keys binary, vals binary")
        every = self.spark.createDataFrame(pa.table({"share": pa.array(range(len(bounds) - 1), pa.int32()), "keys": pa.array([b""] * (len(bounds) - 1), pa.binary()), "vals": pa.array([b""] * (len(bounds) - 1), pa.binary())}))
        return sums.unionByName(every).repartitionById(len(bounds) - 1, "share").mapInArrow(_on_units(order, unit, bounds, work, fold), schema)

    def per_part(self, of: np.ndarray, work: OnPart, fold: int = 1 << 20) -> DataFrame:
        """(idx, val): work applied to each connected part of the places that ``of`` marks.
        A part must fit one task, an index's label the driver."""
        idx = self.idx

        def run(at: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(idx[at]), pa.array(work(at, row, col, val))], ["idx", "val"])

        return self.per_unit(np.where(of, self.part, -1), run, "idx long, val double", fold)

    def apply(self, v: np.ndarray) -> np.ndarray:
        """B' (B v) in one job; the matrix is not made."""
        n, out = len(v), np.zeros(len(v))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros(n)
            for b in batches:
                for starts, at, val in zip(*(b.column(k) for k in range(3))):
                    starts, at, val = _numbers(starts, np.int64), _numbers(at, np.int32), _numbers(val, np.float64)
                    y += np.bincount(at, val * np.repeat(np.add.reduceat(val * v[at], starts), np.diff(np.r_[starts, len(at)])), n)
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary())], ["y"])

        for y in self.packed.coalesce(64).mapInArrow(multiply, "y binary").toArrow().column("y"):
            out += _numbers(y, np.float64)
        return out


def per_gram_part(b: DataFrame, idx: np.ndarray, work: OnPart, piece: int = 1 << 16, fold: int = 1 << 20) -> DataFrame:
    """(idx, val): work applied to each connected part of B' B over idx, indices without
    entries (parts of their own) included."""
    return GramParts(b, idx, piece).per_part(np.ones(len(idx), bool), work, fold)


def _numbers(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _linked(n: int, nodes: Iterable[pa.Scalar], parts: Iterable[pa.Scalar], part: np.ndarray | None = None) -> np.ndarray:
    """The smallest place that each of n is connected to by all labels."""
    part = np.arange(n) if part is None else part
    for u, v in zip(nodes, parts):
        part = K.least_linked(np.concatenate([np.arange(n), _numbers(u, np.int32)]), np.concatenate([part, _numbers(v, np.int32)]))[1]
    return part


def _joined(n: int):
    """Labels of many tasks to those of one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(n)
        for b in batches:
            part = _linked(n, b.column(0), b.column(1), part)
        nodes = np.flatnonzero(part != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (nodes, part[nodes])], ["nodes", "parts"])

    return join


def _shares(part: np.ndarray, tasks: int) -> np.ndarray:
    """The task of each index's part: largest parts first, each to the task with the
    least work so far (the cube of a part's size, and something for any part)."""
    of, sizes = np.unique(part, return_inverse=True, return_counts=True)[1:]
    shares, loads = np.empty(len(sizes), np.int64), [(0.0, k) for k in range(min(tasks, len(sizes)))]
    for p in np.argsort(-sizes, kind="stable").tolist():
        load, k = loads[0]
        shares[p] = k
        heapq.heapreplace(loads, (load + float(sizes[p]) ** 3 + 1e5, k))
    return shares[of]


def _by_rows(idx: np.ndarray, piece: int):
    """Whole rows of B as runs of places in idx, about ``piece`` entries at a time, and
    what the rows link."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches]
        if not held or not len(idx):
            return
        row, col, val = (np.concatenate(x) for x in zip(*held))
        at = np.minimum(np.searchsorted(idx, col), len(idx) - 1)
        known = idx[at] == col
        row, at, val = row[known], at[known], val[known]
        if not len(row):
            return
        order = np.lexsort((at, row))
        row, at, val = row[order], at[order], val[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
        row, at, val = row[first], at[first].astype(np.int32), np.add.reduceat(val, first)
        some = val != 0
        row, at, val = row[some], at[some], val[some]
        if not len(row):
            return
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        heads = np.repeat(at[starts], np.diff(np.r_[starts, len(at)]))
        nodes, low = K.least_linked(heads, at)
        yield _record([nodes.astype(np.int32), low.astype(np.int32), None, None, None])
        k = 0
        while k < len(starts):
            end = max(k + 1, int(np.searchsorted(starts, starts[k] + piece)))
            lo, hi = starts[k], starts[end] if end < len(starts) else len(at)
            yield _record([None, None, (starts[k:end] - lo).astype(np.int64), at[lo:hi], val[lo:hi]])
            k = end

    def _record(columns: list[np.ndarray | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x if x is None else x.tobytes()], pa.binary()) for x in columns], ["nodes", "parts", "starts", "places", "vals"])

    return pack


def _folded(key: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of equal keys added up; keys sorted."""
    if not len(key):
        return key, val
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(val[order], first)


def _products(place: np.ndarray, unit: np.ndarray | None, bounds: np.ndarray, fold: int):
    """Sums of products of entries in one row of B and one unit (None: rows are), by
    share; a key is place of row times number of places and place of column, which is
    not after the row's."""
    n = int(bounds[-1])

    def pairs(starts: np.ndarray, at: np.ndarray, val: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a number of entries at a time that has about ``fold`` pairs."""
        sizes = np.diff(np.r_[starts, len(at)])
        start = np.repeat(starts, sizes)
        size = np.arange(1, len(at) + 1) - start  # an entry with those of its row up to itself
        ends, p = np.cumsum(size), place[at]
        u = None if unit is None else unit[at]
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + fold, "right")))
            mine = size[lo:hi]
            left = np.repeat(np.arange(lo, hi), mine)
            right = np.arange(len(left)) - np.repeat(np.cumsum(mine) - mine, mine) + start[left]
            if u is not None:
                same = (u[left] == u[right]) & (u[left] >= 0)
                left, right = left[same], right[same]
            yield p[left] * n + p[right], val[left] * val[right]
            lo = hi

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for starts, at, val in zip(*(b.column(k) for k in range(3))):
                for found in pairs(_numbers(starts, np.int64), _numbers(at, np.int32), _numbers(val, np.float64)):
                    held.append(found)
                    size += len(found[0])
                    if size >= fold:
                        yield from sent(held)
                        held, size = [], 0
        if held:
            yield from sent(held)

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, val = _folded(*(np.concatenate(x) for x in zip(*held)))
        cuts = np.searchsorted(key, bounds * n)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[k], cuts[k + 1])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([key[own].tobytes()], pa.binary()), pa.array([val[own].tobytes()], pa.binary())], ["share", "keys", "vals"])

    return multiply


def _on_units(order: np.ndarray, unit: np.ndarray, bounds: np.ndarray, work: OnUnit, fold: int):
    n = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}
        for b in batches:
            for k, key, val in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                held.setdefault(k, []).append((_numbers(key, np.int64), _numbers(val, np.float64)))
                size[k] = size.get(k, 0) + len(held[k][-1][0])
                if size[k] > max(2 * fold, 2 * len(held[k][0][0])):
                    held[k] = [_folded(*(np.concatenate(x) for x in zip(*held[k])))]
                    size[k] = len(held[k][0][0])
        for k in sorted(held):
            key, val = _folded(*(np.concatenate(x) for x in zip(*held.pop(k))))
            key, val = key[val != 0], val[val != 0]
            own = order[bounds[k] : bounds[k + 1]]
            heads = bounds[k] + np.flatnonzero(np.r_[True, unit[own][1:] != unit[own][:-1]][: len(own)])
            ends = np.r_[heads[1:], bounds[k + 1]]
            cuts = np.searchsorted(key, np.r_[heads, bounds[k + 1]] * n)
            for i, (lo, hi) in enumerate(zip(heads, ends)):
                row, col = (x.astype(np.int32) for x in np.divmod(key[cuts[i] : cuts[i + 1]] - lo * (n + 1), n))
                off, v = row != col, val[cuts[i] : cuts[i + 1]]
                row, col, v = np.r_[row, col[off]], np.r_[col, row[off]], np.r_[v, v[off]]
                yield work(order[lo:hi], row, col, v)

    return run
