"""Near-duplicates at a similarity of word shingles, by wide bit-sliced fingerprints.

simhash.py links fingerprints of 64 bits at a few bits, which only nearly equal
texts reach.  Here a document has BITS bits, and two are linked if they differ in
no more than belong to a given Jaccard similarity of their shingles: similarity s
means a cosine of 2 s / (1 + s) at least, and so at most acos(.) / pi of the bits,
with a margin for chance.

The comparison is the same: planes of bits are kept vertically, 64 documents to a
machine word; carry-save counters add up the differing planes of many pairs at
once, and a counter that passes the radius stays marked, so words without a pair
in reach are abandoned.

Candidates share one of BANDS keys, each made of ROWS least hashes: a pair of
similarity s has none in common with probability (1 - s^ROWS)^BANDS, 0.00003 at 0.8.

At scale: documents of equal fingerprints and keys are one node.  A key with more
than TILE nodes is cut into tiles, and pairs of tiles are compared in separate
tasks.  A comparison returns a spanning forest of its links, never all pairs, and
does not compare what is already linked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import by_key, cut, mixed, sliced, text_columns
from .components import components
from .simhash import Forest, _shifted, lanes_of, majorities, planes, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Machine words of a fingerprint, and its bits.
WIDTH = 16
BITS = 64 * WIDTH
#: Standard deviations of the number of differing bits that the radius leaves for chance.
MARGIN = 2.0
BANDS, ROWS = 20, 4
#: Nodes of one key that are compared in one task, at most.
TILE = 4096
#: Groups up to this size are compared by shifting planes, larger ones a batch of queries at a time.
SHIFTED, BATCH = 48, 64
#: Candidate rows dealt to a group of applyInArrow, on average.
PART_ROWS = 100_000

_ODD = np.random.default_rng(20240607).integers(1, 1 << 63, WIDTH + BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_of(similarity: float = SIMILARITY, bits: int = BITS, margin: float = MARGIN) -> int:
    """Differing bits up to which documents count as this similar."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def profiles(hashes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x WIDTH) and keys (n x BANDS) of lists of shingle hashes; those
    of an empty list are zero."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    flat = np.array([x for part in hashes for x in part], np.uint64)
    fps, keys = np.zeros((len(hashes), WIDTH), np.uint64), np.zeros((len(hashes), BANDS), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return fps, keys
    for w in range(WIDTH):
        fps[:, w] = majorities(mixed(flat * _ODD[w]), sizes)
    begins = (np.cumsum(sizes) - sizes)[full]
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for odd in _ODD[WIDTH + b * ROWS : WIDTH + (b + 1) * ROWS]:
            key = mixed(key * _ODD[0] + np.minimum.reduceat(flat * odd, begins))
        keys[full, b] = key
    return fps, keys


def _nodes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, node, fp, keys) of every row; a node stands for fingerprint and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in sliced(batch, "text"):
                fps, keys = profiles([shingle_hashes(x, shingle) for x in part])
                # a last key of the fingerprint itself: equal ones always meet
                own = np.array([[int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little")] for x in fps], np.uint64)
                keys = np.concatenate([keys, own], axis=1)
                node = [hashlib.blake2b(f.tobytes() + k.tobytes(), digest_size=16).digest() for f, k in zip(fps, keys)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), pa.array(node, pa.binary()), pa.array([x.tobytes() for x in fps], pa.binary()), lists], ["doc_id", "node", "fp", "keys"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, node binary, fp binary, keys array<long>")


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry and sum of three bits in every lane."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def within(difference: Callable[[int, np.ndarray], np.ndarray], n_planes: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``alive`` whose differing planes are ``radius`` at most.

    difference(p, at) gives plane p's differences in the words ``at``.  Eight planes
    are added by carry-save adders to ones, twos and fours, their carry to further
    counters.  Counters begin so that they run over beyond the radius."""
    at = np.flatnonzero(alive)
    size = max(4, radius.bit_length())
    start = (1 << size) - 1 - radius
    full = ~np.uint64(0)
    counters = [np.full(len(at), full if start >> i & 1 else 0, np.uint64) for i in range(size)]
    live = alive[at]
    for p in range(0, n_planes, 8):
        d = [difference(q, at) for q in range(p, p + 8)]
        ones, twos, fours, *upper = counters
        a, ones = _added(ones, d[0], d[1])
        b, ones = _added(ones, d[2], d[3])
        e, twos = _added(twos, a, b)
        a, ones = _added(ones, d[4], d[5])
        b, ones = _added(ones, d[6], d[7])
        f, twos = _added(twos, a, b)
        carry, fours = _added(fours, e, f)
        for i, c in enumerate(upper):
            upper[i], carry = c ^ carry, c & carry
        live = live & ~carry
        counters = [ones, twos, fours, *upper]
        if p % 64 == 56:
            keep = live != 0
            if not keep.any():
                return np.zeros_like(alive)
            if keep.mean() < 0.7:
                at, live, counters = at[keep], live[keep], [c[keep] for c in counters]
    out = np.zeros_like(alive)
    out[at] = live
    return out


def wide_planes(fps: np.ndarray) -> np.ndarray:
    """BITS x ceil(n / 64) words of n fingerprints."""
    return np.concatenate([planes(np.ascontiguousarray(fps[:, w])) for w in range(fps.shape[1])])


def _packed(lanes: np.ndarray) -> np.ndarray:
    """Words of a matrix of lanes, each row padded to whole words."""
    rows, n = lanes.shape
    padded = np.zeros((rows, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = lanes
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root index) of the pairs of one group within the
    radius.  fps must be sorted by group; a group of more than SHIFTED rows that have
    both sides 0 and 1 is only compared across."""
    n = len(fps)
    forest = Forest(n)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHIFTED), sizes))
    if len(rows):
        v, g = wide_planes(fps[rows]), group[rows]
        for d in range(1, SHIFTED):
            same = np.zeros((1, v.shape[1] * 64), np.uint8)
            if d < len(g):
                same[0, : len(g) - d] = g[d:] == g[:-d]
            alive = _packed(same)[0]
            if not alive.any():
                break
            moved = _shifted(v, d)
            i = lanes_of(within(lambda p, at, moved=moved: v[p, at] ^ moved[p, at], len(v), alive, radius))
            forest.link(rows[i], rows[i + d])
    for k in np.flatnonzero(sizes > SHIFTED):
        _link_large(forest, fps, side, int(starts[k]), int(sizes[k]), radius)
    root = forest.roots(np.arange(n))
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def _link_large(forest: Forest, fps: np.ndarray, side: np.ndarray, first: int, n: int, radius: int) -> None:
    """Links of one large group, BATCH queries at a time against all rows before them
    that are not yet linked to them."""
    v, full = wide_planes(fps[first : first + n]), ~np.uint64(0)
    across, width = side[first] != side[first + n - 1], v.shape[1]
    for q in range(0, n, BATCH):
        queries = np.arange(q, min(q + BATCH, n))
        # most rows of a group of copies are near a root: that prunes the comparison
        roots = np.unique(forest.roots(np.arange(first, first + queries[-1] + 1)))
        if len(roots) <= 4 * BATCH:
            far = np.bitwise_count(fps[first + queries][:, None, :] ^ fps[roots][None, :, :]).sum(axis=2)
            a, b = np.nonzero((far <= radius) & ((side[first + queries][:, None] != side[roots][None, :]) | (not across)))
            forest.link(first + queries[a], roots[b])
        of = forest.roots(np.arange(first, first + n))
        want = (np.arange(n)[None, :] < queries[:, None]) & (of[None, :] != of[queries][:, None])
        if across:
            want &= side[first : first + n][None, :] != side[first + queries][:, None]
        alive = _packed(want).ravel()
        if not alive.any():
            continue
        bits = np.where(np.unpackbits(fps[first + queries].view(np.uint8), axis=1, bitorder="little").astype(bool), full, np.uint64(0)).T
        hit = within(lambda p, at, bits=bits: v[p, at % width] ^ bits[p, at // width], len(v), alive, radius)
        lane = lanes_of(hit)
        forest.link(first + queries[lane // (64 * width)], first + lane % (64 * width))


def link_edges(nodes: DataFrame, n_nodes: int, radius: int) -> DataFrame:
    """(a, b): a spanning forest, key by key, of the links between nodes (node, fp, keys)."""
    rows = nodes.select("node", "fp", F.explode("keys").alias("key"))
    large = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE))
    rows = rows.join(large, "key", "left")
    tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # a row of tile i is compared with every tile: pairs (low, high) that contain i
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(j, F.col("tile")).alias("low"), F.greatest(j, F.col("tile")).alias("high")))
    rows = rows.select("node", "fp", "key", "tile", F.explode(pairs).alias("p")).select("node", "fp", "key", "p.low", "p.high", (F.col("tile") == F.col("p.high")).cast("int").alias("side"))
    parts = by_key(PART_ROWS, nodes.sparkSession, (BANDS + 1) * n_nodes)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "low", "high"), F.lit(parts)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        node = np.array(t.column("node").to_pylist(), dtype=object)
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDTH)
        key, low, high, side = (t.column(c).to_numpy() for c in ("key", "low", "high", "side"))
        order = np.lexsort((side, high, low, key))
        new = np.zeros(len(order), bool)
        for c in (key, low, high):
            new[1:] |= c[order][1:] != c[order][:-1]
        child, root = links(fps[order], np.cumsum(new), side[order], radius)
        node = node[order]
        return pa.table({"a": pa.array(node[child].tolist(), pa.binary()), "b": pa.array(node[root].tolist(), pa.binary())})

    return rows.groupBy("part").applyInArrow(compare, "a binary, b binary")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id that is
    reachable by links of documents at least this similar.

    Texts without a word (null, empty, blank) have fingerprint zero and are linked;
    of texts with fewer words than a shingle the whole sequence is one.  A null id
    belongs to its component but is never its smallest (it is null only if no row
    of the component has an id).  Repeated rows are linked.  An empty table gives
    no rows.
    """
    rows = cut(_nodes(docs, id_col, text_col, shingle))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    edges = link_edges(nodes, nodes.count(), radius_of(similarity))
    found = cut(components(edges)).withColumnRenamed("node", "of")
    rooted = nodes.join(found, nodes["node"] == found["of"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(smallest, "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(answer, "node").select("doc_id", "component_id")
