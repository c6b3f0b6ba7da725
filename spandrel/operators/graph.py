"""Pattern graphs: symmetrizing, colouring, blocking, quotients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import kernels as K
from .blocks import graph_labels
from .structure import ordered_by, reordered


def graph(a: DataFrame) -> DataFrame:
    return a.select(F.col("row").alias("src"), F.col("col").alias("dst"))


def reversed_edges(g: DataFrame) -> DataFrame:
    return g.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrized(g: DataFrame) -> DataFrame:
    """The union of the graph and its transpose."""
    return g.select("src", "dst").union(reversed_edges(g)).distinct()


def colored(g: DataFrame, kind: str = "greedy", nodes: DataFrame | None = None, most: int = 5_000_000) -> DataFrame:
    """(idx, color) by a colouring in index order of a symmetric graph, colours from 1.
    Greedy graphs of more than ``most`` edges are coloured in rounds, with the same
    result; the cyclic kinds follow one node after another and are refused there."""
    if kind == "greedy" and g.count() > most:
        own = [] if nodes is None else [nodes.select(F.col("idx").alias("src"), F.col("idx").alias("dst"))]
        return colored_parallel(g.select("src", "dst").unionByName(own[0]) if own else g, order="index", most_rounds=100_000)
    return graph_labels(g, K.COLORINGS[kind], "color", nodes, most)


def colored_parallel(g: DataFrame, most_rounds: int = 200, order: str = "hash") -> DataFrame:
    """(idx, color) for graphs of any size: in every round the nodes that come first
    among their free neighbours take the smallest colour their neighbours do not
    have.  Order "hash" needs few rounds; order "index" gives the greedy colouring of
    index order, in as many rounds as its longest chain of neighbours."""
    edges = written(g.where("src <> dst").select("src", "dst").distinct())
    rank = F.xxhash64("idx") if order == "hash" else -F.col("idx")
    state = written(g.select(F.col("src").alias("idx")).union(g.select(F.col("dst").alias("idx"))).distinct().select("idx", rank.alias("h"), F.lit(None).cast("long").alias("color")))
    for _ in range(most_rounds):
        far = state.select(F.col("idx").alias("dst"), F.col("h").alias("_h"), F.col("color").alias("_c"))
        seen = edges.join(far, "dst").groupBy(F.col("src").alias("idx")).agg(F.max(F.when(F.col("_c").isNull(), F.struct("_h", F.col("dst").alias("_i")))).alias("top"), F.collect_set("_c").alias("used"))
        now = state.join(seen, "idx", "left")
        first = F.col("color").isNull() & (F.col("top").isNull() | (F.struct(F.col("h").alias("_h"), F.col("idx").alias("_i")) > F.col("top")))
        used = F.coalesce("used", F.array().cast("array<bigint>"))
        free = F.array_min(F.array_except(F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda c: c.cast("long")), used))
        state = written(now.select("idx", "h", F.when(first, free).otherwise(F.col("color")).alias("color")))
        if state.where("color is null").limit(1).count() == 0:
            return state.select("idx", "color")
    raise RuntimeError("colouring did not end")


def multicolor(a: DataFrame, kind: str = "greedy"):
    """P A P' with rows sorted by colour, the permutation, and the colours."""
    colors = colored(symmetrized(graph(a)), kind)
    pi = ordered_by(colors)
    return reordered(a, pi)[0], pi, colors


def simple_blocks(nodes: DataFrame, size: int) -> DataFrame:
    """(node, block, slot): runs of ``size`` indices, blocks from 1."""
    return nodes.select(F.col("idx").alias("node"), (F.expr(f"idx div {size}") + 1).alias("block"), F.expr(f"idx % {size}").alias("slot"))


def connected_blocks(g: DataFrame, size: int) -> DataFrame:
    """(node, block, slot): blocks of exactly ``size`` connected nodes where possible."""
    labels = graph_labels(g, lambda x: K.connected_blocks(x, size), "block")
    slot = F.row_number().over(Window.partitionBy("block").orderBy("idx")) - 1
    return labels.select(F.col("idx").alias("node"), "block", slot.cast("long").alias("slot"))


def block_graph(g: DataFrame, members: DataFrame, same_slot: bool = False) -> DataFrame:
    """Distinct edges (bsrc, bdst) between blocks; with same_slot, only those that an
    edge between equal slots makes."""
    a = members.select(F.col("node").alias("src"), F.col("block").alias("bsrc"), F.col("slot").alias("_s"))
    b = members.select(F.col("node").alias("dst"), F.col("block").alias("bdst"), F.col("slot").alias("_t"))
    both = g.join(a, "src").join(b, "dst")
    return (both.where("_s = _t") if same_slot else both).select("bsrc", "bdst").distinct()


def k_way(g: DataFrame, parts: int, separator: bool = True) -> DataFrame:
    """(idx, part): parts along a breadth-first order (no partitioning library is
    used); with separator, part ``parts`` holds nodes whose removal parts the rest."""

    def label(x: dict[int, set[int]]) -> dict[int, int]:
        found = K.breadth_first_parts(x, parts)
        return K.with_separator(x, found, parts) if separator else found

    return graph_labels(symmetrized(g), label, "part")
