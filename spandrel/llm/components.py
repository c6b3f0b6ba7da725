"""Connected components of an edge table, by alternating large and small stars.

Each round hooks every node's larger (smaller) neighbours to the smallest
neighbour.  A hub is met by grouped minima, which are summed map-side, and by
joins, which adaptive execution splits; no node's neighbours are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node
    that is reachable.  Loops and repeated edges do no harm."""
    rows = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = _mark(rows)
    for _ in range(most_rounds):
        rows = cut(_small_star(_large_star(rows)))
        # a fixed point is a forest of stars: same rows as before
        before, mark = mark, _mark(rows)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not converge")
    stars = rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(rows.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(rows: DataFrame) -> tuple:
    """Number and 128 bits of hashes of a set of rows: equal for equal sets, and for
    others with probability 2^-128."""
    return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first())


def _large_star(rows: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hooked to its smallest neighbour or itself."""
    both = rows.select("u", "v").union(rows.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(rows: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hooked to the smallest of them."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"))
    others = rows.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
