"""Reporting over result rows and convergence logs.

Result files hold C-formatted numbers (nan, -nan, inf), so they are read as
strings and parsed.  Spark takes NaN as larger than every number; the masks
below say what they mean for NaN themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import placed_lines, positioned, ranked

FIELDS = ("Problem", "Method", "Prec", "M2", "M3", "M4", "W", "Precond", "ACC", "Time", "Iter", "ImplRes", "ExplRes")
_LONGS, _TEXTS = {"M2", "M3", "M4", "Iter"}, {"Problem", "Method", "Prec", "Precond"}
TOLERANCE = 1e-8
#: Log lines that are numbered together.
LOG_RUN = 1 << 16
#: Names of the halved precision in the two result files, and the name reports use.
BEST = ("_Float16", "__half")
#: Parameter sweeps over (m2, m3, m4): one of them varies.
SWEEPS = {"m4": r"^8-4-\d+$", "m3": r"^8-\d+-2$", "m2": r"^\d+-4-2$"}


def parsed_number(text: Column) -> Column:
    """A double from C's formats; what is no number is null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("nan", "-nan"), F.lit(float("nan"))).when(t.isin("inf", "infinity"), F.lit(float("inf"))).when(t == "-inf", F.lit(float("-inf"))).otherwise(t.try_cast("double"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files with a header; line is the row's place in its file."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in FIELDS)).option("header", True).csv(path)
    typed = [F.trim(F.col(c)).alias(c) if c in _TEXTS else F.col(c).try_cast("long").alias(c) if c in _LONGS else parsed_number(F.col(c)).alias(c) for c in FIELDS]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return positioned(raw.select(*typed, *place), "line")


def write_results(df: DataFrame, path: str) -> None:
    """Appends result rows as CSV with a header; rows without a problem are skipped."""
    df.where(F.length("Problem") > 0).select(*FIELDS).write.mode("append").option("header", True).csv(path)


def tagged(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("Tag", F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))


def named_best(df: DataFrame) -> DataFrame:
    """The halved precision under its common name."""
    return df.withColumn("Prec", F.when(F.col("Prec").isin(*BEST), "Best").otherwise(F.col("Prec")))


def masked(df: DataFrame, value: str, zero: bool = False) -> DataFrame:
    """Failed runs (implicit residual above the tolerance) lose their value: null, for
    NaN residuals too; or with zero, 0, and a NaN residual keeps the value."""
    res, nan = F.col("ImplRes"), F.isnan("ImplRes")
    if zero:
        return df.withColumn(value, F.when(~nan & (res > TOLERANCE), 0.0).otherwise(F.col(value)))
    return df.withColumn(value, F.when(~nan & (res <= TOLERANCE), F.col(value)))


def versus_baseline(df: DataFrame, tag: str, value: str, name: str, inverse: bool = True) -> DataFrame:
    """Rows other than the baseline's with name = baseline / row (or row / baseline).
    A problem must have one baseline row; one without any raises."""
    base = df.where(F.col("Tag") == tag).groupBy("Problem").agg(F.max(value).alias("_b"), F.count(F.lit(1)).alias("_n"))
    others = df.where(F.col("Tag") != tag).join(base, "Problem", "left")
    one = F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.raise_error(F.concat(F.lit("no single baseline for "), F.col("Problem"))))
    top, bottom = (one, F.col(value)) if inverse else (F.col(value), one)
    return others.withColumn(name, top / F.when(bottom != 0, bottom)).drop("_b", "_n")


def sweep(df: DataFrame, which: str) -> DataFrame:
    return df.where(F.col("Tag").rlike(SWEEPS[which]))


def pivoted(parts: Sequence[DataFrame], tags: Sequence[str], value: str = "Iter") -> DataFrame:
    """Problem by tag, in the given column order; a (problem, tag) that occurs twice
    raises, a missing one is null."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    cells = rows.where(F.col("Tag").isin(*tags)).groupBy("Problem", "Tag").agg(F.first(value).alias("v"), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("twice: "), F.col("Problem"))))
    return cells.withColumn("v", checked).groupBy("Problem").pivot("Tag", list(tags)).agg(F.first("v"))


def stable_by_problem(df: DataFrame) -> DataFrame:
    return df.orderBy("Problem", "line")


def systematic(df: DataFrame, step: int, key: str = "line") -> DataFrame:
    """Every step-th row by a whole-number key, counted from the first."""
    return ranked(df, key, "_r").where(F.col("_r") % step == 0).drop("_r")


def labelled(df: DataFrame, names: dict[str, str], column: str = "Tag") -> DataFrame:
    """Display names; a tag without one keeps its own."""
    if not names:
        return df.withColumn("Label", F.col(column))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn("Label", F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def parsed_log(lines: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(problem, run, step, relres) of log lines (line, value): a line that begins with
    one of the prefixes opens a run, others are "step value".  Lines of step 0 are
    dropped; each run begins with step 0 and 1.0."""
    head = F.lit(False)
    for p in prefixes:
        head = head | F.col("value").startswith(p)
    # runs of lines: heads are counted within a run and over the runs before it, so the
    # only global window is over one row a run
    own = F.when(F.col("head"), F.split("value", ",")[0])
    rows = lines.withColumn("head", head).withColumn("part", F.floor(F.col("line") / LOG_RUN)).withColumn("own", own)
    parts = rows.groupBy("part").agg(F.count("own").alias("n"), F.max_by("own", F.when(F.col("head"), F.col("line"))).alias("final"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.last("final", ignorenulls=True).over(before).alias("carried"))
    by = Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.count("own").over(by)).withColumn("latest", F.last("own", ignorenulls=True).over(by)).join(parts, "part")
    rows = rows.withColumn("run", F.col("earlier") + F.col("inside")).withColumn("problem", F.coalesce("latest", "carried")).where("run > 0")
    f = F.split(F.trim("value"), r"\s+")
    steps = rows.where(~F.col("head")).select("problem", "run", f[0].try_cast("int").alias("step"), parsed_number(F.try_element_at(f, F.lit(2))).alias("relres")).where("step > 0")
    first = rows.where("head").select("problem", "run", F.lit(0).alias("step"), F.lit(1.0).alias("relres"))
    return first.unionByName(steps)


def read_log(spark: SparkSession, path: str, prefixes: Sequence[str]) -> DataFrame:
    return parsed_log(positioned(placed_lines(spark, path), "line"), prefixes)


def log_axis(runs: DataFrame, calls: int = 64) -> DataFrame:
    """x: applications of the innermost preconditioner, ``calls`` a logged step."""
    at = F.row_number().over(Window.partitionBy("run").orderBy("step")) - 1
    return runs.withColumn("x", calls * at)


def with_labels(runs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The n-th label for the n-th run."""
    return runs.withColumn("label", F.try_element_at(F.array(*[F.lit(x) for x in labels]), F.col("run").cast("int")))


def mean_of_repetitions(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean time and the whole part of the mean number of iterations."""
    return runs.groupBy(*keys).agg(F.avg("Time").alias("Time"), F.expr("sum(Iter) div count(*)").alias("Iter"))


def parameter_sweep(spark: SparkSession, problems: Sequence[str], programs: Sequence[str], grid: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Every problem with every program and every (m2, m3, m4)."""
    cell = F.array(*[F.struct(F.lit(a).alias("m2"), F.lit(b).alias("m3"), F.lit(c).alias("m4")) for a, b, c in grid])
    rows = spark.createDataFrame([(x,) for x in problems], "problem string").select("problem", F.explode(F.array(*[F.lit(x) for x in programs])).alias("program"))
    return rows.select("problem", "program", F.explode(cell).alias("g")).select("problem", "program", "g.*")


def text_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line) of a fixed-width table, columns right-aligned to their longest value or
    name; a null is written as NaN.  The heading is a row of its own: text_heading."""
    widths = _widths(df, columns)
    cells = [F.lpad(_shown(c), widths[c], " ") for c in columns]
    return df.select(F.concat_ws(" ", *cells).alias("line"))


def text_heading(df: DataFrame, columns: Sequence[str]) -> str:
    widths = _widths(df, columns)
    return " ".join(c.rjust(widths[c]) for c in columns)


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("NaN"))


def _widths(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.max(F.length(_shown(c))).alias(c) for c in columns]).first()
    return {c: max(len(c), row[c] or 0) for c in columns}


#: Problem, diagonal factor and best (m2, m3, m4), by platform and symmetry.
CATALOGUE = {
    ("cpu", True): """
        audikw_1 1.1 7 4 2, Bump_2911 1.1 8 5 2, ecology2 1.0 8 5 2, Emilia_923 1.0 8 5 2, G3_circuit 1.0 9 4 2,
        hpcg_7_7_7 1.0 9 4 2, hpcg_8_7_7 1.0 6 4 2, hpcg_8_8_7 1.0 7 4 2, hpcg_8_8_8 1.0 6 4 2, ldoor 1.1 8 5 2,
        Queen_4147 1.1 8 4 2, Serena 1.1 8 6 2, thermal2 1.0 9 4 2, tmt_sym 1.0 8 6 2""",
    ("cpu", False): """
        atmosmodd 1.0 8 6 2, atmosmodj 1.0 9 4 2, atmosmodl 1.0 8 3 2, hpgmp_7_7_7 1.0 8 4 1, hpgmp_8_7_7 1.0 8 4 1,
        hpgmp_8_8_7 1.0 8 4 1, hpgmp_8_8_8 1.0 6 4 2, ss 1.1 8 4 2, stokes 1.0 8 4 1, t2em 1.0 6 4 2,
        tmt_unsym 1.0 10 4 2, Transport 1.0 8 3 2, vas_stokes_1M 1.0 8 4 1, vas_stokes_2M 1.0 8 4 1""",
    ("gpu", True): """
        apache2 1.0 8 4 2, audikw_1 1.6 8 6 2, Bump_2911 1.2 8 6 2, ecology2 1.0 8 5 2, Emilia_923 1.2 8 5 2,
        G3_circuit 1.0 9 4 2, hpcg_7_7_7 1.0 8 6 2, hpcg_8_7_7 1.0 8 3 2, hpcg_8_8_7 1.0 6 4 2, hpcg_8_8_8 1.0 6 4 2,
        ldoor 1.3 8 6 2, Queen_4147 1.3 10 4 2, Serena 1.2 7 4 2, thermal2 1.0 10 4 2, tmt_sym 1.0 8 6 2""",
    ("gpu", False): """
        atmosmodd 1.0 8 2 2, atmosmodj 1.0 8 2 2, atmosmodl 1.0 8 6 2, Freescale1 1.1 9 4 2, hpgmp_7_7_7 1.0 8 2 2,
        hpgmp_8_7_7 1.0 6 4 2, hpgmp_8_8_7 1.0 8 2 2, hpgmp_8_8_8 1.0 6 4 2, ss 1.2 8 6 2, stokes 1.3 8 4 1,
        t2em 1.0 9 4 2, tmt_unsym 1.0 8 5 2, Transport 1.0 9 4 2, vas_stokes_1M 1.3 8 4 1, vas_stokes_2M 1.3 8 4 1,
        rajat31 1.0 8 4 1""",
}


def problem_catalogue(spark: SparkSession) -> DataFrame:
    """(platform, symmetric, place, problem, acc, m2, m3, m4): the problems that the
    experiments run over, in their order."""
    rows = []
    for (platform, symmetric), text in CATALOGUE.items():
        for place, cell in enumerate(text.split(",")):
            name, acc, *best = cell.split()
            rows.append((platform, symmetric, place, name, float(acc), *map(int, best)))
    return spark.createDataFrame(rows, "platform string, symmetric boolean, place int, problem string, acc double, m2 int, m3 int, m4 int")
