"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are kept vertically: plane p holds bit p of many fingerprints, 64
to a machine word.  One exclusive-or a plane gives the differences of 64 pairs;
carry-save counters (ones, twos, and a sticky "four or more") add them up, and
words in which every lane has passed the radius are abandoned.

Candidates: the 64 bits are cut into BANDS parts; fingerprints within RADIUS
bits agree on BANDS - RADIUS parts at least, so grouping by every choice of so
many parts loses no link.  Only distinct fingerprints are grouped.

At scale: a group of more than TILE fingerprints is cut into tiles, and pairs
of tiles are compared in separate tasks, so no task holds more than two tiles.
A comparison returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, sliced, text_columns
from .components import components

RADIUS, BANDS, SEED = 3, 5, 42
SHINGLE = 3
#: Fingerprints of one candidate group that are compared in one task, at most.
TILE = 4096
#: Groups up to this size are compared by shifting planes, larger ones query by query.
SHIFTED = 48
#: Candidate rows dealt to a group of applyInArrow, on average.
PART_ROWS = 200_000

_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of k words, or of the whole sequence if shorter."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of hashes of these sizes, the bits set in more than half of a run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    raw = hashes.view(np.uint8).reshape(-1, 8)
    # lanes of bytes count up to 255 hashes at a time
    begins = np.cumsum(sizes) - sizes
    cuts = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begins[full], sizes[full])])
    owner = np.repeat(full, -(-sizes[full] // 255))
    counts = np.zeros((len(sizes), 64), np.int64)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, byte]], cuts)
        np.add.at(counts[:, 8 * byte : 8 * byte + 8], owner, lanes.view(np.uint8).reshape(-1, 8))
    bits = 2 * counts > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """The SimHash of each list: bits set in more than half of its hashes."""
    return majorities(np.array([x for part in hashes for x in part], np.uint64), np.array([len(x) for x in hashes], np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of([shingle_hashes(x) for x in part]) for _, part in sliced(batch, "text")]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words: bit i of word w of plane p is bit p of fps[64 w + i]."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def lanes_of(words: np.ndarray) -> np.ndarray:
    """Indices of the set lanes of a row of words."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def near_lanes(difference, n_planes: int, alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes of ``alive`` whose differing planes are ``radius`` (0 to 3) at most.

    difference(p, at) gives plane p's differences in the words ``at``.  Words
    without a lane within the radius are dropped every few planes."""
    at = np.flatnonzero(alive)
    ones, twos = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    live = alive[at]
    for p in range(n_planes):
        d = difference(p, at)
        carry = ones & d
        ones ^= d
        more = twos & carry
        twos ^= carry
        live &= ~more
        if radius < 3:
            live &= ~(twos & ones) if radius == 2 else ~twos if radius == 1 else ~(twos | ones)
        if p % 8 == 7:
            keep = live != 0
            if not keep.any():
                return np.zeros_like(alive)
            if keep.mean() < 0.7:
                at, ones, twos, live = at[keep], ones[keep], twos[keep], live[keep]
    out = np.zeros_like(alive)
    out[at] = live
    return out


def _shifted(words: np.ndarray, d: int) -> np.ndarray:
    """Lane i of the result is lane i + d of the words (zeros beyond the end)."""
    whole, part = divmod(d, 64)
    out = np.zeros_like(words)
    n = words.shape[-1] - whole
    if n <= 0:
        return out
    out[..., :n] = words[..., whole:] >> np.uint64(part)
    if part and n > 1:
        out[..., : n - 1] |= words[..., whole + 1 :] << np.uint64(64 - part)
    return out


class Forest:
    """Spanning forest of links between numbered nodes."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook roots to smaller roots until all linked nodes share theirs."""
        p = self.parent
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        p, r = self.parent, self.parent[x]
        while True:
            up = p[r]
            if (up == r).all():
                p[x] = r
                return r
            r = up


def links(fps: np.ndarray, group: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root index) of the pairs of one group within the
    radius.  fps must be sorted by group; with ``side``, a group whose rows have
    both sides 0 and 1 is only compared across."""
    n = len(fps)
    forest = Forest(n)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    small = np.repeat(sizes <= SHIFTED, sizes)
    rows = np.flatnonzero(small & np.repeat(sizes > 1, sizes))
    d = 1
    while len(rows):
        v = planes(fps[rows])
        g = group[rows]
        while d < SHIFTED:
            same = np.zeros(v.shape[1] * 64, np.uint8)
            if d < len(g):
                same[: len(g) - d] = g[d:] == g[:-d]
            alive = np.packbits(same, bitorder="little").view(np.uint64)
            if not alive.any():
                rows = rows[:0]
                break
            moved = _shifted(v, d)
            i = lanes_of(near_lanes(lambda p, at: v[p, at] ^ moved[p, at], 64, alive, radius))
            forest.link(rows[i], rows[i + d])
            d += 1
            if d & (d - 1) == 0:  # from time to time only rows of groups that are large enough go on
                break
        else:
            break
        if len(rows):
            rows = rows[np.isin(group[rows], group[starts[sizes > d]])]
    for k in np.flatnonzero(sizes > SHIFTED):
        a, m = starts[k], sizes[k]
        v = planes(fps[a : a + m])
        lane = np.arange(m)
        for q in range(m):
            of = forest.roots(a + lane)
            want = (lane < q) & (of != of[q])  # what is linked already is not compared
            if not want.any():
                continue
            if side is not None and side[a] != side[a + m - 1]:
                want &= side[a : a + m] != side[a + q]
            padded = np.zeros(v.shape[1] * 64, np.uint8)
            padded[:m] = want
            bits = fps[a + q]
            i = lanes_of(near_lanes(lambda p, at: ~v[p, at] if (int(bits) >> p) & 1 else v[p, at], 64, np.packbits(padded, bitorder="little").view(np.uint64), radius))
            if len(i):
                forest.link(np.full(len(i), a + q), a + i)
    root = forest.roots(np.arange(n))
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def band_masks(bands: int = BANDS, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of bands - radius of the parts of 64 bits."""
    edges = [64 * i // bands for i in range(bands + 1)]
    parts = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(bands)]
    return [sum(c) for c in combinations(parts, bands - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_edges(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(a, b): a spanning forest, group by group, of the links between the
    distinct fingerprints in nodes (fp)."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(band_masks())])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    large = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    rows = rows.join(large, ["t", "key"], "left")
    tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # a row of tile i is compared with every tile: pairs (low, high) that contain i
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, F.col("tile")).alias("low"), F.greatest(j, F.col("tile")).alias("high")))
    rows = rows.select("fp", "t", "key", "tile", F.explode(pairs).alias("p")).select("fp", "t", "key", F.col("p.low").alias("low"), F.col("p.high").alias("high"), (F.col("tile") == F.col("p.high")).cast("int").alias("side"))
    parts = by_key(PART_ROWS, nodes.sparkSession, 10 * n_nodes)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("t", "key", "low", "high"), F.lit(parts)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        fp, key = t.column("fp").to_numpy(), t.column("key").to_numpy()
        others = [t.column(c).to_numpy() for c in ("side", "high", "low", "t")]
        order = np.lexsort((fp, others[0], others[1], others[2], key, others[3]))
        fp, side = fp[order], others[0][order]
        new = np.zeros(len(fp), bool)
        for c in (key, *others[1:]):
            new[1:] |= c[order][1:] != c[order][:-1]
        child, root = links(fp.view(np.uint64), np.cumsum(new), side)
        return pa.table({"a": fp[child], "b": fp[root]})

    return rows.groupBy("part").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: component_id is the
    smallest doc_id whose fingerprint is reachable by links of RADIUS bits.

    Texts without a word (null, empty, blank) have fingerprint zero and are
    linked like any other; of short texts the whole sequence is one shingle.
    A null id belongs to its component but is never its smallest (it is null
    only if no row of the component has an id).  Repeated rows are linked.  An
    empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = link_edges(nodes.select("fp"), nodes.count())
    found = cut(components(edges))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
