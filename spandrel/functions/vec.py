"""Vector and dense-matrix algebra on (idx, val) and (idx, j, val) frames.

Elementwise operators are projections; binary ones are one join on the index;
reductions are map-side sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: divided(a, b),
}


def divided(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: signed infinity, or NaN for 0 / 0, where b is 0."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def inverted(a: Column) -> Column:
    return divided(F.lit(1.0), a)


def rooted(a: Column) -> Column:
    return F.when(a < 0, F.lit(float("nan"))).otherwise(F.sqrt(a))


UNARY: dict[str, Callable[[Column], Column]] = {"inv": inverted, "neg": lambda a: -a, "abs": F.abs, "sqrt": rooted}


def mapped(v: DataFrame, f: Callable[[Column], Column] | str) -> DataFrame:
    """v with f (a function of a column, or the name of one in UNARY) on its values."""
    return v.withColumn("val", (UNARY[f] if isinstance(f, str) else f)(F.col("val")))


def scaled(v: DataFrame, a: float) -> DataFrame:
    return v.withColumn("val", F.lit(a) * F.col("val"))


def combined(x: DataFrame, y: DataFrame, op: str | Callable[[Column, Column], Column], keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    """x op y elementwise, by name in OPERATORS or any function of two columns;
    keys ("idx", "j") for dense matrices."""
    f = OPERATORS[op] if isinstance(op, str) else op
    other = y.select(*keys, F.col("val").alias("_y"))
    return x.join(other, list(keys)).select(*keys, f(F.col("val"), F.col("_y")).alias("val"))


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    return combined(x, y, lambda p, q: F.lit(a) * p + q)


def cast(v: DataFrame, kind: str) -> DataFrame:
    """Precision change: "double", "float", or "half" (rounded to 16 bits, stored as
    float)."""
    return v.withColumn("val", half(F.col("val")) if kind == "half" else F.col("val").cast(kind))


def half(x: Column) -> Column:
    """Values rounded to IEEE half precision (nearest, ties to even; subnormal numbers
    and overflow to infinity included), as floats."""
    v, a = x.cast("double"), F.abs(x.cast("double"))
    e = F.floor(F.log2(F.when((a > 0) & (a < float("inf")), a).otherwise(1.0)))
    # the logarithm may miss a power of two by one
    e = e + F.when(a >= F.pow(F.lit(2.0), e + 1), 1).when(a < F.pow(F.lit(2.0), e), -1).otherwise(0)
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    near = F.rint(a / step) * step
    size = F.when(F.isnan(a) | (a == float("inf")), a).when(near > 65504, float("inf")).otherwise(near)
    return F.when(v < 0, -size).otherwise(size).cast("float")


def cast_array(values: Column, kind: str) -> Column:
    """Precision change of an array of numbers, as cast() has it."""
    return F.transform(values, lambda v: half(v) if kind == "half" else v.cast(kind))


def half_mapped(v: DataFrame, f: str) -> DataFrame:
    """abs or sqrt in single precision, rounded back to half."""
    return cast(mapped(cast(v, "float"), f), "half")


def element(v: DataFrame, i: int) -> DataFrame:
    return v.where(F.col("idx") == i)


def column(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("j") == j).select("idx", "val")


def prefix(v: DataFrame, length: int) -> DataFrame:
    return v.where(F.col("idx") < length)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return combined(x, y, "mul").agg(F.sum("val").alias("val"))


def norm(v: DataFrame) -> DataFrame:
    return v.agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("val"))


def total(v: DataFrame) -> DataFrame:
    return v.agg(F.sum("val").alias("val"))


def dense_times(m: DataFrame, v: DataFrame) -> DataFrame:
    """Sum over j of m[idx, j] * v[j], over the entries v has."""
    w = v.select(F.col("idx").alias("j"), F.col("val").alias("_v"))
    return m.join(w, "j").groupBy("idx").agg(F.sum(F.col("val") * F.col("_v")).alias("val"))


# complex values are structs of re and im


def cmul(a: Column, b: Column) -> Column:
    re, im = lambda c: c["re"], lambda c: c["im"]
    return F.struct((re(a) * re(b) - im(a) * im(b)).alias("re"), (re(a) * im(b) + im(a) * re(b)).alias("im"))


def conj(a: Column) -> Column:
    return F.struct(a["re"].alias("re"), (-a["im"]).alias("im"))


def csum(a: Column) -> Column:
    return F.struct(F.sum(a["re"]).alias("re"), F.sum(a["im"]).alias("im"))


def complex_dot(x: DataFrame, y: DataFrame, conjugate: bool = True) -> DataFrame:
    """Sum of conj(x) * y, or of x * y."""
    p = combined(x, y, lambda a, b: cmul(conj(a) if conjugate else a, b))
    return p.agg(csum(F.col("val")).alias("val"))
