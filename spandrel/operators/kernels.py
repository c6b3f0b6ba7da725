"""Sequential kernels on one block, in numpy and Python.

A block is a dict of rows: rows[i] = {column: value}.  These run inside grouped
Arrow functions, one group per block, so blocks are worked on in parallel and a
block's size bounds a task's memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np

Rows = dict[int, dict[int, float]]


def rows_of(row: Iterable[int], col: Iterable[int], val: Iterable[float]) -> Rows:
    """Rows of entries; entries that repeat are added up."""
    out: Rows = {}
    for i, j, v in zip(row, col, val):
        r = out.setdefault(i, {})
        r[j] = r.get(j, 0.0) + v
    return out


def entries(rows: Rows):
    """Lists (row, col, val) in row and column order."""
    flat = [(i, j, rows[i][j]) for i in sorted(rows) for j in sorted(rows[i])]
    return [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]


def _pivot(rows: Rows, k: int) -> float:
    d = rows.get(k, {}).get(k, 0.0)
    if d == 0.0:
        raise ValueError(f"row {k} has no usable pivot")
    return d


def ilu(rows: Rows, level: int = 0, acc: float = 1.0) -> Rows:
    """Incomplete LU in place of the matrix: below the diagonal L (unit diagonal),
    from it on U.  Fill is kept up to ``level``; diagonals are first multiplied by
    acc."""
    out: Rows = {}
    levels: dict[int, dict[int, int]] = {}
    for i in sorted(rows):
        w = {j: v * acc if j == i else v for j, v in rows[i].items()}
        lev = dict.fromkeys(w, 0)
        todo = sorted(j for j in w if j < i)
        at = 0
        while at < len(todo):
            k = todo[at]
            at += 1
            if lev[k] > level:
                continue
            f = w[k] = w[k] / _pivot(out, k)
            for j, u in out[k].items():
                if j <= k:
                    continue
                reach = lev[k] + levels[k][j] + 1
                if j in w:
                    lev[j] = min(lev[j], reach)
                elif reach <= level:
                    w[j], lev[j] = 0.0, reach
                    if j < i:
                        todo = todo[:at] + sorted([*todo[at:], j])
                else:
                    continue
                w[j] -= f * u
        out[i] = {j: v for j, v in w.items() if lev[j] <= level}
        levels[i] = lev
        _pivot(out, i)
    return out


def solve_lower(rows: Rows, b: dict[int, float], unit: bool = True) -> dict[int, float]:
    """Forward substitution with the entries up to the diagonal."""
    x: dict[int, float] = {}
    for i in sorted(b):
        s = b[i] - sum(v * x[j] for j, v in rows.get(i, {}).items() if j < i)
        x[i] = s if unit else s / _pivot(rows, i)
    return x


def solve_upper(rows: Rows, b: dict[int, float]) -> dict[int, float]:
    """Back substitution with the entries from the diagonal on."""
    x: dict[int, float] = {}
    for i in sorted(b, reverse=True):
        s = b[i] - sum(v * x[j] for j, v in rows.get(i, {}).items() if j > i)
        x[i] = s / _pivot(rows, i)
    return x


def solve_tiles(tiles: dict[tuple[int, int], np.ndarray], b: dict[int, float], height: int, width: int, lower: bool, unit: bool) -> dict[int, float]:
    """Substitution by rows of dense tiles: what lies before (after) the rows of a strip
    is one product a tile, the square on the diagonal is solved row by row."""
    lo, hi = min(b), max(b) + 1
    x, rhs = np.zeros(hi - lo), np.array([b[i] for i in range(lo, hi)])
    strips: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (i, j), t in tiles.items():
        strips.setdefault(i, []).append((j, t))
    for i in sorted({k // height for k in range(lo, hi)}, reverse=not lower):
        top, end = max(lo, i * height), min(hi, (i + 1) * height)
        left, square = rhs[top - lo : end - lo].copy(), np.zeros((height, height))
        for j, t in strips.get(i, ()):
            cols = np.arange(j * width, (j + 1) * width)
            own = (cols >= top) & (cols < end)
            square[:, cols[own] - i * height] = t[:, own]
            done = (cols >= lo) & (cols < top) if lower else (cols >= end) & (cols < hi)
            left -= t[top - i * height : end - i * height, done] @ x[cols[done] - lo]
        for r in range(top, end) if lower else range(end - 1, top - 1, -1):
            k = r - i * height
            before = slice(top - i * height, k) if lower else slice(k + 1, end - i * height)
            s = left[r - top] - square[k, before] @ x[before.start + i * height - lo : before.stop + i * height - lo]
            if not unit and square[k, k] == 0.0:
                raise ValueError(f"row {r} has no usable pivot")
            x[r - lo] = s if unit else s / square[k, k]
    return dict(zip(range(lo, hi), x.tolist()))


def approximate_inverse(rows: Rows, tol: float = 0.1, acc: float = 1.0, follow_fill: bool = False) -> tuple[Rows, Rows, dict[int, float]]:
    """Biconjugation: (Z, W, d) with the inverse about Z diag(1/d) W'.  Z and W are
    given by vectors: z[i], w[i].  Vector i is made conjugate to the earlier ones
    that its row or column of the matrix touches; with follow_fill, to those its
    growing vectors touch as well.  Entries below tol are dropped; a zero d is 1."""
    cols: Rows = {}
    for i, r in rows.items():
        for j, v in r.items():
            cols.setdefault(j, {})[i] = v
    dot = lambda a, b: sum(v * b[k] for k, v in a.items() if k in b)

    def add(a: dict[int, float], f: float, b: dict[int, float], own: int) -> None:
        for k, v in b.items():
            a[k] = a.get(k, 0.0) + f * v
        for k in [k for k, v in a.items() if k != own and (abs(v) < tol or v == 0.0)]:
            del a[k]

    z: Rows = {}
    w: Rows = {}
    d: dict[int, float] = {}
    for i in sorted(rows):
        zi, wi = {i: 1.0}, {i: 1.0}
        row, col = rows[i], cols.get(i, {})
        near = sorted(k for k in {*row, *col} if k < i and k in d)
        seen, followed = set(near), set()
        at = 0
        while at < len(near):
            c = near[at]
            at += 1
            f_w, f_z = dot(z[c], row), dot(w[c], col)
            if f_w:
                add(wi, -f_w / d[c], w[c], i)
            if f_z:
                add(zi, -f_z / d[c], z[c], i)
            if follow_fill:
                fresh = {*zi, *wi} - followed  # what an index touched before is seen or before c
                followed |= fresh
                more = {k for m in fresh for k in (*rows.get(m, {}), *cols.get(m, {})) if c < k < i and k in d and k not in seen}
                if more:
                    seen |= more
                    near[at:] = sorted({*near[at:], *more})
        wi[i] *= acc
        z[i], w[i] = zi, wi
        d[i] = dot(wi, col) or 1.0
    return z, w, d


def whole_inverse(row: np.ndarray, col: np.ndarray, val: np.ndarray, acc: float = 1.0, follow_fill: bool = False, panel: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """approximate_inverse without dropping, dense and by panels of vectors: the sorted
    indices, Z and W with a vector a row, and d.  Coefficients come from the rows and
    columns of the matrix alone, so those to all earlier panels are one product."""
    nodes = np.unique(row)
    n, own = len(nodes), np.isin(col, nodes)
    i, j = np.searchsorted(nodes, row[own]), np.searchsorted(nodes, col[own])
    a = np.zeros((n, n))
    np.add.at(a, (i, j), val[own])
    near = np.ones((1, 1), bool)
    if not follow_fill:
        near = np.zeros((n, n), bool)
        near[i, j] = near[j, i] = True
    near = np.broadcast_to(near, (n, n))
    z, w, d = np.eye(n), np.eye(n), np.ones(n)
    for p in range(0, n, panel):
        q = min(n, p + panel)
        for of, to in (((a[p:q, :p] @ z[:p, :p].T), w), ((a[:p, p:q].T @ w[:p, :p].T), z)):
            to[p:q, :p] -= (of / d[:p] * near[p:q, :p]) @ to[:p, :p]
        for k in range(p, q):
            for of, to in ((z[p:k, :k] @ a[k, :k], w), (w[p:k, :k] @ a[:k, k], z)):
                to[k, :k] -= (of / d[p:k] * near[k, p:k]) @ to[p:k, :k]
            w[k, k] *= acc
            d[k] = (w[k, : k + 1] @ a[: k + 1, k]) or 1.0
    return nodes, z, w, d


# graphs: adjacency by node, without loops


def least_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of pairs (u, v), and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[i], low[j])
        np.minimum.at(new, low[j], low[i])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def adjacency(src: Iterable[int], dst: Iterable[int], nodes: Iterable[int] = ()) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in zip(src, dst):
        out.setdefault(a, set())
        out.setdefault(b, set())
        if a != b:
            out[a].add(b)
    return out


def color_greedy(g: dict[int, set[int]]) -> dict[int, int]:
    """First fit in index order; colours from 1."""
    color: dict[int, int] = {}
    for n in sorted(g):
        used = {color[m] for m in g[n] if m in color}
        color[n] = next(c for c in range(1, len(used) + 2) if c not in used)
    return color


def color_cyclic(g: dict[int, set[int]], colors: int | None = None) -> dict[int, int] | None:
    """Colours in turn: each node takes the next colour after its predecessor's that
    no neighbour has.  None if ``colors`` (by default one more than the greatest
    degree) do not suffice."""
    most = colors or max((len(x) for x in g.values()), default=0) + 1
    color: dict[int, int] = {}
    start = 0
    for n in sorted(g):
        used = {color[m] for m in g[n] if m in color}
        free = next((c for k in range(most) if (c := (start + k) % most + 1) not in used), None)
        if free is None:
            return None
        color[n], start = free, free
    return color


def color_hybrid(g: dict[int, set[int]], more: int = 30) -> dict[int, int]:
    """Cyclic colours, as many as greedy needs, or up to ``more`` more."""
    least = max(color_greedy(g).values(), default=1)
    for extra in range(more + 1):
        if (found := color_cyclic(g, least + extra)) is not None:
            return found
    raise ValueError("no cyclic colouring with so few colours")


COLORINGS = {"greedy": color_greedy, "cyclic": color_cyclic, "hybrid": color_hybrid}


def connected_blocks(g: dict[int, set[int]], size: int) -> dict[int, int]:
    """Blocks of exactly ``size`` nodes (the last may be smaller), grown breadth-first
    and begun anew at the smallest free node; blocks from 1."""
    block: dict[int, int] = {}
    queue: deque[int] = deque()
    queued: set[int] = set()
    for seed in sorted(g):
        if seed in queued:
            continue
        queue.append(seed)
        queued.add(seed)
        while queue:
            n = queue.popleft()
            block[n] = len(block) // size + 1
            fresh = sorted(m for m in g[n] if m not in queued)
            queue.extend(fresh)
            queued.update(fresh)
    return block


def breadth_first_parts(g: dict[int, set[int]], parts: int) -> dict[int, int]:
    """Parts of equal size along a breadth-first order: a plain stand-in for a graph
    partitioner; parts from 0."""
    size = max(1, -(-len(g) // parts))
    return {n: b - 1 for n, b in connected_blocks(g, size).items()}


def with_separator(g: dict[int, set[int]], part: dict[int, int], parts: int) -> dict[int, int]:
    """Moves nodes of the larger side of each cut edge to part ``parts``, until no edge
    joins two of the others."""
    out, sizes = dict(part), {}
    for p in part.values():
        sizes[p] = sizes.get(p, 0) + 1
    for n in sorted(g):
        for m in sorted(g[n]):
            a, b = out[n], out[m]
            if a != b and parts not in (a, b):
                loser = n if (sizes[a], a) >= (sizes[b], b) else m
                sizes[out[loser]] -= 1
                out[loser] = parts
    return out


# classical coarsening


def coarse_points(strong: dict[int, set[int]]) -> set[int]:
    """Coarse points in two passes.  First: the free point that most free or fine
    points depend on becomes coarse and those that depend on it fine; what fine
    points depend on gains importance.  Second: of two fine points that depend on
    each other without a common coarse point, the first is made coarse."""
    depends: dict[int, set[int]] = {n: set() for n in strong}
    for n, ms in strong.items():
        for m in ms:
            depends.setdefault(m, set()).add(n)
    nodes = sorted({*strong, *depends})
    weight = {n: len(depends.get(n, ())) for n in nodes}
    free, coarse = set(nodes), set()
    by_weight: dict[int, set[int]] = {}
    for n in nodes:
        by_weight.setdefault(weight[n], set()).add(n)

    def reweigh(n: int, more: int) -> None:
        by_weight[weight[n]].discard(n)
        weight[n] += more
        by_weight.setdefault(weight[n], set()).add(n)

    while free:
        top = max(w for w, s in by_weight.items() if s)
        n = min(by_weight[top])
        by_weight[top].discard(n)
        free.discard(n)
        if top <= 0:
            continue  # nothing depends on it: fine
        coarse.add(n)
        for f in sorted(depends.get(n, set()) & free):
            free.discard(f)
            by_weight[weight[f]].discard(f)
            for m in strong.get(f, set()) & free:
                reweigh(m, 1)
        for m in strong.get(n, set()) & free:
            reweigh(m, -1)
    for n in nodes:
        if n in coarse:
            continue
        own = strong.get(n, set())
        if any(m not in coarse and m > n and not (own & strong.get(m, set()) & coarse) for m in own):
            coarse.add(n)
    return coarse
