"""Solves a matrix file and prints one result row a repetition count:

    python -m spandrel.solve FILE ACC REPETITIONS [M2 M3 M4 PERIOD RESTART [WEIGHT]]
        [--method f3r] [--precision double] [--preconditioner bjilu0] [--blocks 112]

Without M2 and what follows, the method is a plain one (cg, bicgstab, gmres).  With
WEIGHT the weight is fixed (static).  A right-hand side is FILE's <name>_b.mtx or,
without one, pseudo-random in [0, 1)."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.nested import Config, report_rows, run_systems
from .session import session
from .sources.matrix_market import read_system
from .sources.stencils import pseudo_random


def parsed(argv: list[str] | None = None) -> tuple[str, int, Config]:
    """File, repetitions and configuration of an argument list."""
    p = argparse.ArgumentParser(prog="python -m spandrel.solve")
    p.add_argument("file")
    p.add_argument("acc", type=float)
    p.add_argument("repetitions", type=int)
    p.add_argument("depths", type=float, nargs="*", metavar="M2 M3 M4 PERIOD RESTART [WEIGHT]")
    p.add_argument("--method")
    p.add_argument("--precision", default="double", choices=("double", "float", "half"))
    p.add_argument("--preconditioner", default="bjilu0", choices=("bjilu0", "sdainv"))
    p.add_argument("--blocks", type=int, default=112)
    a = p.parse_args(argv)
    if len(a.depths) not in (0, 5, 6):
        p.error("M2 M3 M4 PERIOD RESTART go together, WEIGHT after them")
    config = Config(a.method or ("cg" if not a.depths else "static" if len(a.depths) == 6 else "f3r"), a.precision, acc=a.acc, blocks=a.blocks, preconditioner=a.preconditioner)
    if a.depths:
        config.m2, config.m3, config.m4, config.period, config.restart = (int(x) for x in a.depths[:5])
    if len(a.depths) == 6:
        config.omega = a.depths[5]
    return a.file, a.repetitions, config


def solved(spark: SparkSession, path: str, repetitions: int, config: Config) -> DataFrame:
    """The result row of a file."""
    a, meta, b = read_system(spark, path, lambda n: pseudo_random(spark, n))
    config.blocks = min(config.blocks, meta.nrows)
    name = F.lit(os.path.basename(path).removesuffix(".mtx")).alias("system")
    return report_rows(run_systems(a.select(name, "*"), b.select(name, "*"), config, repetitions), config)


def main(argv: list[str] | None = None) -> None:
    path, repetitions, config = parsed(argv)
    for row in solved(session(), path, repetitions, config).collect():
        print(",".join(str(x) for x in row))


if __name__ == "__main__":
    main()
