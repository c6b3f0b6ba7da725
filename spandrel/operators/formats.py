"""Storage formats as frames: compressed rows and columns, tiles, slices.

Grouped formats are one shuffle on their group; products need no conversion
back, they join on the column like spmat does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import cast_array


def csr(a: DataFrame) -> DataFrame:
    """(row, entries): each row's entries sorted by column; repeats stay."""
    return a.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("entries"))


def csc(a: DataFrame) -> DataFrame:
    """(col, entries): each column's entries sorted by row."""
    return a.groupBy("col").agg(F.array_sort(F.collect_list(F.struct("row", "val"))).alias("entries"))


def entries_of(compressed: DataFrame) -> DataFrame:
    """(row, col, val) of csr or csc."""
    key = "row" if "row" in compressed.columns else "col"
    return compressed.select(key, F.explode("entries").alias("e")).select(key, "e.*").select("row", "col", "val")


def row_pointers(a: DataFrame, domain: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(row, lo, hi): each row's range among all entries in row order.

    Counts are prefix-summed within blocks of rows and over the blocks' totals, so
    the only global window runs over one row per block."""
    counts = domain.select(F.col("idx").alias("row")).join(a.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "left")
    counts = counts.select("row", F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"row div {block}").alias("b"))
    totals = counts.groupBy("b").agg(F.sum("n").alias("t"))
    before = totals.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("hi", inside).join(before, "b").select("row", (F.col("s") + F.col("hi") - F.col("n")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi"))


def bcsr(a: DataFrame, height: int, width: int) -> DataFrame:
    """(brow, bcol, vals): dense tiles, column by column within a tile; entries that
    repeat are added up."""
    cell = F.expr(f"cast((col % {width}) * {height} + row % {height} as int)")
    cells = a.select(F.expr(f"row div {height}").alias("brow"), F.expr(f"col div {width}").alias("bcol"), F.struct(cell.alias("c"), "val").alias("e"))
    tiles = cells.groupBy("brow", "bcol").agg(F.collect_list("e").alias("m"))
    at = lambda i: F.aggregate(F.filter("m", lambda e: e["c"] == i), F.lit(0.0), lambda s, e: s + e["val"])
    return tiles.select("brow", "bcol", F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at).alias("vals"))


def from_bcsr(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """All cells of all tiles, zeros included."""
    cells = tiles.select("brow", "bcol", F.posexplode("vals").alias("c", "val"))
    return cells.select((F.col("brow") * height + F.col("c") % height).alias("row"), (F.col("bcol") * width + F.expr(f"c div {height}")).alias("col"), "val")


def spmv_bcsr(tiles: DataFrame, x: DataFrame, height: int, width: int) -> DataFrame:
    """A x: one join per tile column, sums within tiles before the shuffle."""
    xs = x.groupBy(F.expr(f"idx div {width}").alias("bcol")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"cast(idx % {width} as int)"), "val"))).alias("x"))
    at = lambda r, c: F.element_at("vals", F.lit(c * height + r + 1)) * F.coalesce(F.try_element_at("x", F.lit(c)), F.lit(0.0))
    rows = F.array(*[sum((at(r, c) for c in range(1, width)), at(r, 0)) for r in range(height)])
    parts = tiles.join(xs, "bcol").select("brow", F.posexplode(rows).alias("r", "v"))
    return parts.groupBy((F.col("brow") * height + F.col("r")).alias("idx")).agg(F.sum("v").alias("val"))


def residual_bcsr(tiles: DataFrame, x: DataFrame, b: DataFrame, height: int, width: int) -> DataFrame:
    """b - A x over the index of b."""
    return _residual(spmv_bcsr(tiles, x, height, width), b)


def cast_tiles(tiles: DataFrame, kind: str) -> DataFrame:
    """Precision change of tiles; slices have a val column and take vec.cast."""
    return tiles.withColumn("vals", cast_array(F.col("vals"), kind))


def _residual(ax: DataFrame, b: DataFrame) -> DataFrame:
    return b.join(ax.withColumnRenamed("val", "_ax"), "idx", "left").select("idx", (F.col("val") - F.coalesce("_ax", F.lit(0.0))).alias("val"))


def sell(a: DataFrame, width: int = 32, right: bool = False, order: DataFrame | None = None) -> DataFrame:
    """(slice, lane, pos, row, col, val): slices of ``width`` rows, every row padded
    with zeros to the longest of its slice.  Padding repeats the neighbour's
    column.  order (row, place) puts rows in another order first.

    A row is gathered once into a sorted array and padded there; only arrays are
    shuffled by slice."""
    placed = a.select("row", "col", "val", F.col("row").alias("place")) if order is None else a.select("row", "col", "val").join(order, "row")
    rows = placed.groupBy("row", "place").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    rows = rows.withColumn("slice", F.expr(f"place div {width}"))
    missing = F.max(F.size("e")).over(Window.partitionBy("slice")) - F.size("e")
    edge = F.element_at("e", 1 if right else -1)
    padding = F.array_repeat(F.struct(edge["col"].alias("col"), F.lit(0.0).alias("val")), missing)
    full = F.concat(padding, F.col("e")) if right else F.concat(F.col("e"), padding)
    cells = rows.withColumn("full", full).select("slice", F.expr(f"place % {width}").alias("lane"), "row", F.posexplode("full").alias("pos", "c"))
    return cells.select("slice", "lane", F.col("pos").cast("long").alias("pos"), "row", "c.col", "c.val")


def sigma_order(a: DataFrame, sigma: int) -> DataFrame:
    """(row, place): within windows of sigma rows, rows by length, longest first;
    ties by row."""
    lengths = a.groupBy("row").agg(F.count(F.lit(1)).alias("len")).withColumn("w", F.expr(f"row div {sigma}"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("len"), "row")) - 1
    return lengths.select("row", (F.col("w") * sigma + rank).cast("long").alias("place"))


def sell_sigma(a: DataFrame, width: int = 32, sigma: int = 256) -> DataFrame:
    return sell(a, width, order=sigma_order(a, sigma))


def spmv_sell(s: DataFrame, x: DataFrame) -> DataFrame:
    """A x of slices; ``row`` names where each lane's result belongs."""
    v = x.select(F.col("idx").alias("col"), F.col("val").alias("_x"))
    return s.join(v, "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("val") * F.col("_x")).alias("val"))


def residual_sell(s: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """b - A x of slices, over the index of b."""
    return _residual(spmv_sell(s, x), b)
