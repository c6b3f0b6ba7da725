"""Session settings, shared-folder checkpoints and row positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("spandrel")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session.  A temporary folder of this machine serves only a local master where
    that is unset, as in tests; elsewhere it would lose data, so this raises."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spandrel-"))
    return context._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a later table has superseded."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for iterations.

    A checkpoint keeps its plan's size estimate, which a join multiplies: an
    iterate that is joined twice a step squares it, and planning soon takes longer
    than the work.  A table's size is that of its files."""
    return written_at(df)[1]


def written_at(df: DataFrame) -> tuple[str, DataFrame]:
    """written(), with the table's path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df as a table in the shared folder, dealt into buckets by a column: joins on it
    move the other side only, however often they are made."""
    spark = df.sparkSession
    name = f"spandrel_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, column).write.bucketBy(n, column).option("path", f"{shared_folder(spark)}/{name}")
    dealt.format("parquet").saveAsTable(name)
    return spark.table(name)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at) of text lines: the file and the part of it that a line
    was read from, and a number that grows within a part."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("at", F.monotonically_increasing_id())


def positioned(lines: DataFrame, name: str = "pos") -> DataFrame:
    """Rows of (file, block, ...) with their position among all, from 0: files by name,
    parts by place.  The rows of a part are numbered without gaps as they are read,
    so a position needs only the parts' sizes; the only global window runs over one
    row a part."""
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(shifts, ["file", "block"]).withColumn(name, F.col("at") + F.col("_shift")).drop("file", "block", "at", "_shift")


def ranked(df: DataFrame, key: str, name: str, size: int = 1 << 16) -> DataFrame:
    """df with the place of each row by a whole-number key, from 0.  Rows are numbered
    within runs of ``size`` keys and shifted by the runs' sizes, so the only global
    window runs over one row a run."""
    runs = df.withColumn("_run", F.floor(F.col(key) / size))
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(key)) - 1
    return runs.withColumn("_in", inside).join(shifts, "_run").withColumn(name, F.col("_shift") + F.col("_in")).drop("_run", "_in", "_shift")
