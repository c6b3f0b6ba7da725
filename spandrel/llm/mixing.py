"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / weight, u from a hash of its
id and a seed.  A source's target is met by complete epochs over it and then a
fractional one: documents by ascending key until their sizes sum to what is
left of the target.

At scale: the order within a source is found without gathering the source.  A
key falls into one of BINS bins by a monotone map; sizes are summed by source
and bin (map-side first), bins are prefix-summed, and only rows within one bin
are ever sorted together.  The join back to documents is on (source, bin), so
one source with a third of all rows is spread over all its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights of the sources in order, repeating.
CYCLE = (3, 1, 2)
#: Words of the mix, as a share of all words.
TOTAL_SHARE = 1.5
#: A target stops at so many times its source's size.
MAX_EPOCHS = 2
#: Bins of a source's keys.
BINS = 4096
#: Sampling weight of a document by its quality label: good, bad, none.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5, None: 1.0}


def n_words(text: str):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = TOTAL_SHARE, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size) rows, one a source.

    The level L solves sum(min(weight * L, most * size)) = share * sum(size):
    what resharing the excess by weight, again and again, ends in.  Sources are
    visited by the level at which each stops; the windows below run over one
    row per source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (nth + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    s = s.withColumn("stops_at", F.col("cap") / F.col("weight")).withColumn("total", F.lit(share) * F.sum("source_size").over(every))
    up_to = Window.orderBy("stops_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("below", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("weight_left"))
    # the first source, by stopping level, that the level at its turn does not fill
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("stops_at"), F.struct("stops_at", "source", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final"))).alias("target"))


def unit_interval(key: str, seed: int):
    """A number in (0, 1) from a key column: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, seed: int = 17, bins: int = BINS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row;
    weights are (doc_id, weight) rows, one an id, 1.0 for ids without a row.

    The fractional epoch takes whole documents in key order; the one at the
    boundary is taken if that brings the sum nearer to the target.  A null or
    wordless text has size 0 and takes nothing; a null source is a source of
    its own, the last; a non-positive weight counts as the smallest
    positive one, a null weight as 1.  Ties in keys go by doc_id.  Rows that repeat a doc_id are
    sampled as separate documents with one key.  An empty table gives no rows.
    """
    # texts are measured before anything is shuffled
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"))
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        weight = F.when(F.col("weight").isNull(), 1.0).when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1e-9)
        rows = rows.join(weights.select("doc_id", "weight"), "doc_id", "left").withColumn("weight", weight)
    u = unit_interval("doc_id", seed)
    rows = rows.withColumn("key", -F.log(u) / F.col("weight"))
    # 1 - exp(-key) grows with the key, so bins hold ascending ranges of keys
    rows = cut(rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int")).drop("weight"))
    summed = cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    plan = targets(summed.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = summed.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).withColumnRenamed("source", "of").withColumnRenamed("bin", "at")
    cells = cells.join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("source", "bin_size")
    joined = rows.join(cells, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at"))).drop("of", "at")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    in_bin = Window.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("sum", F.col("before") + F.sum("size").over(in_bin))
    # nearest: the sum with the document is no further from the rest than without it
    once = (F.col("sum") * 2 - F.col("size")) <= F.col("rest") * 2
    copies = (F.col("epochs") + F.when(once, 1).otherwise(0)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
