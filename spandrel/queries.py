"""Registered queries over the reference's operators, and their SQL.

Every query runs over whole tables or generated systems.  Iterative solvers and
sequential kernels are checked by identities (A x is b, L U is A on the pattern,
colours of neighbours differ), which plain SQL states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import vec as V
from .meta import MatrixMeta
from .operators import blocks as B
from .operators import formats as T
from .operators import graph as G
from .operators import parts as GP
from .operators import spmat as S
from .operators import structure as X
from .plans import amg as A
from .plans import krylov as K
from .plans import nested as N
from .plans import precond as P
from .plans import report as R
from .plans.spaces import GATHERED, FrameSpace, GatheredSpace, sized_space
from .session import shared_folder, written
from .sources import matrix_market as M
from .sources import stencils as Z
from .sources.tables import embedding_matrix, order_lines, order_supplier, part_supplier, supplier_index, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# pieces of SQL
_B = "b AS (SELECT l_orderkey AS row, l_suppkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL)"
_P = "p AS (SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL)"
_G = _B + ", g AS (SELECT x.col AS row, y.col AS col, sum(x.val * y.val) AS val FROM b x JOIN b y ON x.row = y.row GROUP BY ALL)"
_X = "x AS (SELECT s_suppkey AS idx, (s_suppkey + 1)::DOUBLE AS val FROM supplier)"
_D = _G + ", d AS (SELECT row AS idx, sqrt(abs(val)) AS d FROM g WHERE row = col), s AS (SELECT g.row, g.col, g.val / (r.d * c.d) AS val FROM g JOIN d r ON g.row = r.idx JOIN d c ON g.col = c.idx)"


def _stencil(n: int, beta: float = 0.0, name: str = "h") -> str:
    return f"""pt AS (SELECT range AS i, range % {n} AS x, range // {n} % {n} AS y, range // {n * n} AS z FROM range({n**3})),
{name} AS (SELECT a.i AS row, b.i AS col, CASE WHEN a.i = b.i THEN 26.0 WHEN a.x = b.x AND a.y = b.y AND b.z = a.z - 1 THEN {-1 - beta}
  WHEN a.x = b.x AND a.y = b.y AND b.z = a.z + 1 THEN {-1 + beta} ELSE -1.0 END::DOUBLE AS val
  FROM pt a JOIN pt b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1)"""


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    """G: the supplier by supplier matrix of quantities on common orders."""
    return S.gram(order_supplier(spark, d))


def ones_up(spark: SparkSession, d: str) -> DataFrame:
    """x: idx + 1 over the suppliers."""
    return supplier_index(spark, d).select("idx", (F.col("idx") + 1).cast("double").alias("val"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """A vector with zeros and negative values: account balances by customer."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("val"))


# ---- vectors


@query("SELECT c_custkey AS idx, c_acctbal + o AS add, c_acctbal - o AS sub, c_acctbal * o AS mul, CASE WHEN o <> 0 THEN c_acctbal / o WHEN c_acctbal > 0 THEN 'inf'::DOUBLE WHEN c_acctbal < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS div FROM (SELECT c_custkey, c_acctbal, (c_custkey % 7)::DOUBLE AS o FROM customer)")
def vec_arith(spark, d):
    """Every customer, divisors that are 0 included."""
    x = _numbers(spark, d)
    y = x.select("idx", (F.col("idx") % 7).cast("double").alias("val"))
    out = x.select("idx")
    for op in V.OPERATORS:
        out = out.join(V.combined(x, y, op).withColumnRenamed("val", op), "idx")
    return out


@query("SELECT c_custkey AS idx, 1 / (c_acctbal - 20000) AS inv, -c_acctbal AS neg, abs(c_acctbal) AS abs, round(sqrt(abs(c_acctbal)), 6) AS sqrt FROM customer")
def vec_inv_sqrt_abs(spark, d):
    x = _numbers(spark, d)
    shifted = V.mapped(V.mapped(x, lambda v: v - 20000.0), "inv").withColumnRenamed("val", "inv")
    parts = [shifted, V.mapped(x, "neg").withColumnRenamed("val", "neg"), V.mapped(x, "abs").withColumnRenamed("val", "abs")]
    root = V.mapped(V.mapped(x, "abs"), "sqrt").select("idx", F.round("val", 6).alias("sqrt"))
    for p in parts[1:] + [root]:
        parts[0] = parts[0].join(p, "idx")
    return parts[0]


@query("SELECT sum((s_suppkey + 1) * (s_suppkey % 5))::DOUBLE AS val FROM supplier")
def vec_dot(spark, d):
    x = ones_up(spark, d)
    return V.dot(x, x.select("idx", (F.col("idx") % 5).cast("double").alias("val")))


@query("SELECT round(sqrt(sum((s_suppkey + 1) * (s_suppkey + 1))), 6) AS val FROM supplier")
def vec_nrm2(spark, d):
    return V.norm(ones_up(spark, d)).select(F.round("val", 6).alias("val"))


@query("SELECT sum(s_suppkey + 1)::DOUBLE AS val FROM supplier")
def vec_reduce(spark, d):
    return V.total(ones_up(spark, d))


@query("SELECT c_custkey AS idx, (c_acctbal::FLOAT)::DOUBLE AS single FROM customer")
def vec_cast_float(spark, d):
    return V.cast(_numbers(spark, d), "float").select("idx", F.col("val").cast("double").alias("single"))


@query("SELECT s_suppkey AS idx, (2.0 * (s_suppkey + 1) + s_suppkey)::DOUBLE AS val FROM supplier WHERE s_suppkey < 50")
def vec_axpy_prefix(spark, d):
    x = ones_up(spark, d)
    return V.prefix(V.axpy(2.0, x, x.withColumn("val", F.col("val") - 1)), 50)


@query("SELECT idx, round(sum(v * (j + 1)), 4) AS val FROM (SELECT vec_id AS idx, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) GROUP BY idx")
def krylov_basis_mv(spark, d):
    v = spark.range(64).select(F.col("id").alias("idx"), (F.col("id") + 1).cast("double").alias("val"))
    return V.dense_times(embedding_matrix(spark, d), v).select(F.col("idx"), F.round("val", 4).alias("val"))


@query("SELECT idx, j, v * v AS val FROM (SELECT vec_id AS idx, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j FROM embeddings)")
def dense_hadamard(spark, d):
    m = embedding_matrix(spark, d)
    return V.combined(m, m, "mul", ("idx", "j"))


@query("SELECT sum(a * a + b * b)::DOUBLE AS re, sum(a * b - b * a)::DOUBLE AS im, sum(a * a - b * b)::DOUBLE AS re_plain, sum(2 * a * b)::DOUBLE AS im_plain FROM (SELECT s_suppkey + 1 AS a, s_suppkey % 3 AS b FROM supplier)")
def complex_dot(spark, d):
    z = ones_up(spark, d).select("idx", F.struct(F.col("val").alias("re"), (F.col("idx") % 3).cast("double").alias("im")).alias("val"))
    plain = V.complex_dot(z, z, conjugate=False).select(F.col("val.re").alias("re_plain"), F.col("val.im").alias("im_plain"))
    return V.complex_dot(z, z).select(F.col("val.re").alias("re"), F.col("val.im").alias("im")).join(plain, F.lit(True))


# a half has 11 bits from its leading one on; the balances are far from its limits
_HALF = "CASE WHEN v = 0 THEN 0 ELSE round_even(v / pow(2, floor(log2(abs(v))) - 10), 0) * pow(2, floor(log2(abs(v))) - 10) END::DOUBLE"


@query(f"SELECT idx, {_HALF} AS val FROM (SELECT c_custkey AS idx, c_acctbal / 100 AS v FROM customer)")
def half_precision(spark, d):
    x = _numbers(spark, d).withColumn("val", F.col("val") / 100)
    return V.cast(x, "half").select("idx", F.col("val").cast("double").alias("val"))


@query("SELECT c_custkey AS idx, round(2.5 + c_acctbal, 6) AS add, round(2.5 * c_acctbal, 6) AS mul, round(c_acctbal / 2.5, 6) AS div, round(c_acctbal - 2.5, 6) AS sub FROM customer")
def vec_scalar(spark, d):
    """A number and a vector, in each operator."""
    x = _numbers(spark, d)
    out = x.select("idx")
    for op, f in V.OPERATORS.items():
        out = out.join(V.mapped(x, lambda v, f=f: F.round(f(v, F.lit(2.5)), 6)).withColumnRenamed("val", op), "idx")
    return out


@query("SELECT idx, j, v + v * 2 AS add, v - v * 2 AS sub, 3.0 * v AS scaled FROM (SELECT vec_id AS idx, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j FROM embeddings)")
def dense_arith(spark, d):
    """Sum and difference of two dense matrices, and a multiple of one."""
    m = embedding_matrix(spark, d)
    twice = m.withColumn("val", F.col("val") * 2)
    out = V.scaled(m, 3.0).withColumnRenamed("val", "scaled")
    for op in ("add", "sub"):
        out = out.join(V.combined(m, twice, op, ("idx", "j")).withColumnRenamed("val", op), ["idx", "j"])
    return out.select("idx", F.col("j").cast("int").alias("j"), "add", "sub", "scaled")


@query("SELECT c_acctbal AS val, (SELECT embedding[4]::DOUBLE FROM embeddings WHERE vec_id = 7) AS cell FROM customer WHERE c_custkey = 7")
def vec_element(spark, d):
    """One element of a vector, and one of a dense matrix's column."""
    cell = V.element(V.column(embedding_matrix(spark, d), 3), 7).select(F.col("val").alias("cell"))
    return V.element(_numbers(spark, d), 7).select("val").join(cell, F.lit(True))


# ---- generators


@query("SELECT range AS idx, range + 0.5::DOUBLE AS up, 2.25::DOUBLE AS same FROM range(1000)")
def fill_iota(spark, d):
    return Z.iota(spark, 1000, 0.5).withColumnRenamed("val", "up").join(Z.filled(spark, 1000, 2.25).withColumnRenamed("val", "same"), "idx")


def _sized(n: int, beta: float) -> Query:
    return lambda spark, d: Z.stencil27(spark, n, n, n, beta)


_QUERIES["stencil_hpcg"], _SQL["stencil_hpcg"] = _sized(8, 0.0), f"WITH {_stencil(8)} SELECT * FROM h"
_QUERIES["stencil_hpgmp"], _SQL["stencil_hpgmp"] = _sized(8, 0.5), f"WITH {_stencil(8, 0.5)} SELECT * FROM h"


@query("SELECT range AS idx, -1.0::DOUBLE + 2.0 * (((range + 3) % 1000003 * 7919 + 104729) % 1000003) / 1000003.0::DOUBLE AS val FROM range(5000)")
def random_fill(spark, d):
    return Z.pseudo_random(spark, 5000, -1.0, 1.0, 3)


# ---- files: written to the shared folder and read again


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"


@query(f"WITH {_P} SELECT * FROM p")
def mm_roundtrip(spark, d):
    path = _file(spark, "parts.mtx")
    M.write_matrix(part_supplier(spark, d), MatrixMeta(table(spark, d, "part").count(), supplier_index(spark, d).count()), path)
    return M.read_matrix(spark, path)[0]


@query("SELECT s_suppkey AS idx, s_acctbal AS val FROM supplier")
def mm_vector_roundtrip(spark, d):
    path = _file(spark, "balances_b.mtx")
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("val"))
    M.write_vector(v, v.count(), path)
    return M.read_vector(spark, path)


@query(f"WITH {_G}, {_X} SELECT g.row, g.col, g.val, x.val AS rhs FROM g JOIN x ON g.row = x.idx")
def mm_system(spark, d):
    """A matrix file and the right-hand side beside it."""
    path, b = _file(spark, "system.mtx"), ones_up(spark, d)
    n = b.count()
    M.write_matrix(gram_matrix(spark, d), MatrixMeta(n, n), path)
    M.write_vector(b, n, path[: -len(".mtx")] + "_b.mtx")
    a, _, rhs = M.read_system(spark, path, lambda n: Z.filled(spark, n, 0.0))
    return a.join(rhs.select(F.col("idx").alias("row"), F.col("val").alias("rhs")), "row")


@query(f"WITH {_G}, {_X} SELECT g.row, g.col, g.val, x.val AS rhs FROM g JOIN x ON g.row = x.idx")
def index_pair_roundtrip(spark, d):
    path, b = _file(spark, "sys_00000001"), ones_up(spark, d)
    M.write_index_coefficients(gram_matrix(spark, d), b, b.count(), path)
    a, _, rhs = M.read_index_coefficients(spark, path)
    return a.join(rhs.select(F.col("idx").alias("row"), F.col("val").alias("rhs")), "row")


@query("SELECT c_name AS Problem, c_mktsegment AS Method, c_custkey AS Iter, CASE WHEN c_acctbal < 0 THEN 'nan'::DOUBLE ELSE c_acctbal END AS ImplRes FROM customer")
def csv_roundtrip(spark, d):
    path = _file(spark, "results.csv")
    c = table(spark, d, "customer")
    given = {"Problem": F.col("c_name"), "Method": F.col("c_mktsegment"), "Iter": F.col("c_custkey"), "ImplRes": F.when(F.col("c_acctbal") < 0, F.lit("-nan")).otherwise(F.col("c_acctbal").cast("string"))}
    R.write_results(c.select(*[given.get(f, F.lit("0")).alias(f) for f in R.FIELDS]), path)
    return R.read_results(spark, path).select("Problem", "Method", "Iter", "ImplRes")


# ---- products


@query(f"WITH {_G}, {_X} SELECT g.row AS idx, sum(g.val * x.val) AS val FROM g JOIN x ON g.col = x.idx GROUP BY g.row")
def spmv_gram(spark, d):
    return S.spmv(gram_matrix(spark, d), ones_up(spark, d))


@query(f"WITH {_B}, {_X} SELECT o_orderkey AS idx, coalesce(sum(b.val * x.val), 0) AS val FROM orders LEFT JOIN b ON b.row = o_orderkey LEFT JOIN x ON b.col = x.idx GROUP BY o_orderkey")
def spmv(spark, d):
    domain = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    return S.spmv(order_supplier(spark, d), ones_up(spark, d), domain)


@query(f"WITH {_B}, {_X}, y AS (SELECT b.row, sum(b.val * x.val) AS v FROM b JOIN x ON b.col = x.idx GROUP BY b.row) SELECT o_orderkey AS idx, o_custkey - coalesce(v, 0)::DOUBLE AS val FROM orders LEFT JOIN y ON y.row = o_orderkey")
def residual(spark, d):
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").cast("double").alias("val"))
    return S.residual(order_supplier(spark, d), ones_up(spark, d), b)


@query(f"WITH {_G} SELECT * FROM g WHERE val <> 0")
def spgemm(spark, d):
    return gram_matrix(spark, d)


@query(f"WITH {_G}, i AS (SELECT s_suppkey AS row, s_suppkey // 4 AS col, 1.0::DOUBLE AS val FROM supplier) SELECT r.col AS row, c.col AS col, sum(g.val) AS val FROM g JOIN i r ON g.row = r.row JOIN i c ON g.col = c.row GROUP BY ALL")
def galerkin(spark, d):
    i = supplier_index(spark, d).select(F.col("idx").alias("row"), F.expr("idx div 4").alias("col"), F.lit(1.0).alias("val"))
    return S.galerkin(gram_matrix(spark, d), i)


@query(f"WITH {_B} SELECT col AS row, row AS col, val FROM b")
def transpose(spark, d):
    return S.transpose(order_supplier(spark, d))


@query(f"WITH {_B} SELECT col AS row, row AS col, val AS re, -(row % 3)::DOUBLE AS im FROM b")
def conj_transpose(spark, d):
    z = order_supplier(spark, d).withColumn("val", F.struct(F.col("val").alias("re"), (F.col("row") % 3).cast("double").alias("im")))
    return S.conjugate_transpose(z).select("row", "col", "val.re", "val.im")


@query(f"WITH {_B} SELECT coalesce(sum(x.val * y.val), 0)::DOUBLE AS val FROM b x JOIN b y ON x.row = y.row WHERE x.col = 1 AND y.col = 2")
def spvec_dot(spark, d):
    b = order_supplier(spark, d)
    x, y = (b.where(F.col("col") == k).select(F.col("row").alias("idx"), "val") for k in (1, 2))
    return S.sparse_dot(x, y)


@query(f"WITH {_B}, z AS (SELECT coalesce(x.row, y.row) AS idx, -0.5 * coalesce(x.val, 0) + coalesce(y.val, 0) AS val FROM (SELECT * FROM b WHERE col = 1) x FULL JOIN (SELECT * FROM b WHERE col = 2) y ON x.row = y.row) SELECT idx, val, idx NOT IN (SELECT row FROM b WHERE col = 2) AS fill FROM z WHERE abs(val) >= 10 AND val <> 0")
def spvec_axpy_drop(spark, d):
    b = order_supplier(spark, d)
    x, y = (b.where(F.col("col") == k).select(F.col("row").alias("idx"), "val") for k in (1, 2))
    z, fill = S.sparse_axpy_fill(-0.5, x, y, 10.0, 1)
    return z.join(fill, "idx", "left").select("idx", "val", F.col("pivot").isNotNull().alias("fill"))


@query(f"WITH {_P} SELECT row, count(*) AS n, max(abs(val)) AS most, sum(val * val) AS squares FROM p GROUP BY row")
def row_aggregates(spark, d):
    p = part_supplier(spark, d)
    return S.row_counts(p).join(S.row_abs_max(p).withColumnRenamed("val", "most"), "row").join(S.row_square_sums(p).withColumnRenamed("val", "squares"), "row")


@query(f"WITH {_P} SELECT col, count(*) AS n FROM p GROUP BY col")
def column_histogram(spark, d):
    return S.column_counts(part_supplier(spark, d))


# ---- formats


@query(f"WITH {_P}, c AS (SELECT row, list(col ORDER BY col) AS cols, list(val ORDER BY col) AS vals FROM p GROUP BY row) SELECT * FROM c")
def coo_to_csr(spark, d):
    return T.csr(part_supplier(spark, d)).select("row", F.expr("transform(entries, e -> e.col)").alias("cols"), F.expr("transform(entries, e -> e.val)").alias("vals"))


@query(f"WITH {_P}, c AS (SELECT col, list(row ORDER BY row) AS rows, list(val ORDER BY row) AS vals FROM p GROUP BY col) SELECT * FROM c")
def coo_to_csc(spark, d):
    return T.csc(part_supplier(spark, d)).select("col", F.expr("transform(entries, e -> e.row)").alias("rows"), F.expr("transform(entries, e -> e.val)").alias("vals"))


@query(f"WITH {_B}, n AS (SELECT o_orderkey AS row, count(b.row) AS n FROM orders LEFT JOIN b ON b.row = o_orderkey GROUP BY o_orderkey) SELECT row, (coalesce(sum(n) OVER w, 0) - n)::BIGINT AS lo, sum(n) OVER w::BIGINT AS hi FROM n WINDOW w AS (ORDER BY row ROWS UNBOUNDED PRECEDING)".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def row_prefix_sum(spark, d):
    return T.row_pointers(order_supplier(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("idx")))


@query(f"WITH {_P} SELECT 'rows' AS by, * FROM p UNION ALL SELECT 'columns', * FROM p")
def csr_roundtrip(spark, d):
    """Entries of compressed rows and of compressed columns."""
    p = part_supplier(spark, d)
    by = lambda name, c: T.entries_of(c).select(F.lit(name).alias("by"), "row", "col", "val")
    return by("rows", T.csr(p)).unionByName(by("columns", T.csc(p)))


@query(f"WITH {_P}, t AS (SELECT DISTINCT row // 4 AS brow, col // 2 AS bcol FROM p), c AS (SELECT brow, bcol, r, k FROM t, (SELECT range AS r FROM range(4)), (SELECT range AS k FROM range(2))) SELECT c.brow, c.bcol, list(coalesce(p.val, 0) ORDER BY k, r) AS vals FROM c LEFT JOIN p ON p.row = brow * 4 + r AND p.col = bcol * 2 + k GROUP BY ALL")
def csr_to_bcsr(spark, d):
    return T.bcsr(part_supplier(spark, d), 4, 2)


@query(f"WITH {_P} SELECT * FROM p")
def bcsr_to_csr(spark, d):
    return T.from_bcsr(T.bcsr(part_supplier(spark, d), 4, 2), 4, 2).where("val <> 0")


_PX = f"WITH {_P}, {_X} SELECT p.row AS idx, sum(p.val * x.val) AS val FROM p JOIN x ON p.col = x.idx GROUP BY p.row"


@query(_PX)
def spmv_bcsr(spark, d):
    p = T.bcsr(part_supplier(spark, d), 4, 2)
    known = part_supplier(spark, d).select(F.col("row").alias("idx")).distinct()
    return T.spmv_bcsr(p, ones_up(spark, d), 4, 2).join(known, "idx", "left_semi")


_SELL = """k AS (SELECT {place} AS place, row, col, val, row_number() OVER (PARTITION BY row ORDER BY col) - 1 AS pos FROM {src}),
l AS (SELECT row, place, count(*) AS len, place // 32 AS slice FROM k GROUP BY row, place), m AS (SELECT *, max(len) OVER (PARTITION BY slice) AS most FROM l),
f AS (SELECT m.slice, m.place % 32 AS lane, range AS pos, m.row, k.col, coalesce(k.val, 0) AS val FROM m, range((SELECT max(most) FROM m)) LEFT JOIN k ON k.row = m.row AND k.pos = range WHERE range < most)
SELECT slice, lane, pos, row, coalesce(last_value(col IGNORE NULLS) OVER (PARTITION BY row ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS col, val FROM f"""


@query(f"WITH {_P}, " + _SELL.format(place="row", src="p"))
def csr_to_sell(spark, d):
    return T.sell(part_supplier(spark, d))


@query(f"WITH {_P}, z AS (SELECT row, count(*) AS n, row // 256 AS w FROM p GROUP BY row), o AS (SELECT row, w * 256 + row_number() OVER (PARTITION BY w ORDER BY n DESC, row) - 1 AS place FROM z), q AS (SELECT p.*, o.place FROM p JOIN o USING (row)), " + _SELL.format(place="place", src="q"))
def csr_to_sellsig(spark, d):
    return T.sell_sigma(part_supplier(spark, d))


@query(_PX)
def spmv_sell(spark, d):
    return T.spmv_sell(T.sell(part_supplier(spark, d), right=True), ones_up(spark, d))


@query(_PX)
def spmv_sellsig(spark, d):
    return T.spmv_sell(T.sell_sigma(part_supplier(spark, d)), ones_up(spark, d))


_PZ = f"WITH {_P}, {_X}, y AS (SELECT p.row, sum(p.val * x.val) AS v FROM p JOIN x ON p.col = x.idx GROUP BY p.row) SELECT p_partkey AS idx, p_size - coalesce(v, 0)::DOUBLE AS val FROM part LEFT JOIN y ON y.row = p_partkey"


def _part_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("val"))


@query(_PZ)
def residual_bcsr(spark, d):
    return T.residual_bcsr(T.bcsr(part_supplier(spark, d), 4, 2), ones_up(spark, d), _part_sizes(spark, d), 4, 2)


@query(_PZ)
def residual_sell(spark, d):
    return T.residual_sell(T.sell(part_supplier(spark, d)), ones_up(spark, d), _part_sizes(spark, d))


@query(_PZ)
def residual_sellsig(spark, d):
    return T.residual_sell(T.sell_sigma(part_supplier(spark, d)), ones_up(spark, d), _part_sizes(spark, d))


@query(_SQL["csr_to_bcsr"].replace("list(coalesce(p.val, 0) ORDER BY k, r)", "list((coalesce(p.val, 0) / 7)::FLOAT::DOUBLE ORDER BY k, r)"))
def cast_bcsr(spark, d):
    tiles = T.cast_tiles(T.bcsr(part_supplier(spark, d).withColumn("val", F.col("val") / 7), 4, 2), "float")
    return tiles.select("brow", "bcol", V.cast_array(F.col("vals"), "double").alias("vals"))


@query(_SQL["csr_to_sell"].replace("coalesce(k.val, 0) AS val", "(coalesce(k.val, 0) / 7)::FLOAT::DOUBLE AS val"))
def cast_sell(spark, d):
    s = V.cast(T.sell(part_supplier(spark, d).withColumn("val", F.col("val") / 7)), "float")
    return s.withColumn("val", F.col("val").cast("double"))


# ---- structure


@query(f"WITH {_G}, m AS (SELECT row, max(abs(val)) AS m FROM g WHERE row <> col GROUP BY row) SELECT count(*) FILTER (g.row <> g.col AND abs(g.val) >= 0.6 * m.m) AS strong, count(*) FILTER (NOT (g.row <> g.col AND abs(g.val) >= 0.6 * m.m)) AS weak FROM g JOIN m ON g.row = m.row")
def strong_counts(spark, d):
    g = X.strong_weak(gram_matrix(spark, d))
    return g.agg(F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"))


@query(f"WITH {_G} SELECT row, col, CASE WHEN row = col THEN 1 / val ELSE val END AS val FROM g WHERE col <= row")
def invert_last(spark, d):
    return X.inverted_diagonal(gram_matrix(spark, d).where("col <= row"))


@query(f"WITH {_G}, m AS (SELECT row, max(abs(val)) AS m FROM g WHERE row <> col GROUP BY row) SELECT g.row, g.col, g.val, g.col % 2 = 0 AS coarse FROM g JOIN m ON g.row = m.row WHERE g.row <> g.col AND abs(g.val) >= 0.6 * m.m")
def strong_split(spark, d):
    """Strong entries by whether their column is coarse; every other supplier is."""
    strong = X.strong_weak(gram_matrix(spark, d)).where("strong")
    coarse, fine = X.by_coarseness(strong, supplier_index(spark, d).where("idx % 2 = 0"))
    return coarse.withColumn("coarse", F.lit(True)).unionByName(fine.withColumn("coarse", F.lit(False)))


@query(f"WITH {_G} SELECT col AS row, row AS col, 0.0::DOUBLE AS val FROM g")
def pattern_transpose(spark, d):
    return S.pattern_transpose(gram_matrix(spark, d))


@query(f"WITH {_G} SELECT row, col, CASE WHEN row = col THEN 1.0 ELSE val END::DOUBLE AS val FROM g WHERE col <= row")
def split_lower(spark, d):
    return X.lower_unit(gram_matrix(spark, d))


@query(f"WITH {_G} SELECT * FROM g WHERE col >= row")
def split_upper(spark, d):
    return X.upper(gram_matrix(spark, d))


@query(f"WITH {_stencil(6)} SELECT row, col, val, least(row // 31, 6) AS block FROM h WHERE least(row // 31, 6) = least(col // 31, 6)")
def block_diag(spark, d):
    return X.block_diagonal(Z.hpcg(spark, 6), 216, 7)


@query(f"WITH {_G} SELECT g.* FROM g JOIN supplier a ON a.s_suppkey = g.row JOIN supplier b ON b.s_suppkey = g.col WHERE a.s_nationkey = b.s_nationkey")
def partition_diag(spark, d):
    return X.partition_diagonal(gram_matrix(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").alias("part")))


@query(f"WITH {_D} SELECT row, col, round(val, 6) AS val FROM s")
def scaling_sym(spark, d):
    return X.scaled_symmetric(gram_matrix(spark, d)).withColumn("val", F.round("val", 6))


@query(f"WITH {_P} SELECT row, col, val / max(abs(val)) OVER (PARTITION BY row) AS val FROM p")
def scaling_row(spark, d):
    return X.scaled_rows(part_supplier(spark, d))


@query(f"WITH {_stencil(5, 0.5)} SELECT 124 - row AS row, 124 - col AS col, val FROM h")
def rotate180(spark, d):
    return X.rotated(Z.hpgmp(spark, 5), 125)


@query(f"WITH {_G}, m AS (SELECT row, max(abs(val)) AS m FROM g WHERE row <> col GROUP BY row) SELECT g.row, g.col, g.val, coalesce(g.row <> g.col AND abs(g.val) >= 0.6 * m.m, false) AS strong FROM g LEFT JOIN m ON g.row = m.row")
def strong_weak(spark, d):
    return X.strong_weak(gram_matrix(spark, d))


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    """The permutation that sorts suppliers by nation and key."""
    return X.ordered_by(table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").alias("key")), "key")


_PI = "pi AS (SELECT s_suppkey AS old, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS new FROM supplier)"


@query(f"WITH {_G}, {_PI} SELECT r.new AS row, c.new AS col, g.val FROM g JOIN pi r ON g.row = r.old JOIN pi c ON g.col = c.old")
def permute_matrix(spark, d):
    return X.reordered(gram_matrix(spark, d), _shuffled(spark, d))[0]


@query(f"WITH {_PI}, {_X} SELECT pi.new AS idx, x.val FROM x JOIN pi ON pi.old = x.idx")
def permute_vector(spark, d):
    return X.permuted_vector(ones_up(spark, d), _shuffled(spark, d))


# ---- graphs


@query("WITH e AS (SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def graph_symmetrize(spark, d):
    """The whole part to supplier pattern: parts have even numbers, suppliers odd ones."""
    return G.symmetrized(table(spark, d, "lineitem").select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).distinct())


_FIRST_FIT = f"""WITH RECURSIVE {_stencil(4)}, c(i, cs) AS (SELECT 0, [1] UNION ALL
SELECT i + 1, list_append(cs, (SELECT min(k) FROM range(1, 40) t(k) WHERE k NOT IN (SELECT cs[h.col + 1] FROM h WHERE h.row = c.i + 1 AND h.col <= c.i))::INTEGER) FROM c WHERE i < 63)
SELECT (generate_subscripts(cs, 1) - 1)::BIGINT AS idx, unnest(cs)::BIGINT AS color FROM c WHERE i = 63"""


@query(_FIRST_FIT)
def color_greedy(spark, d):
    return G.colored(G.symmetrized(G.graph(Z.hpcg(spark, 4))), "greedy")


@query(_FIRST_FIT)
def color_greedy_rounds(spark, d):
    """The colouring in rounds that graphs beyond one task get: the same one."""
    return G.colored(G.symmetrized(G.graph(Z.hpcg(spark, 4))), "greedy", most=0)


def _proper(spark: SparkSession, colors: DataFrame, n: int) -> DataFrame:
    """(nodes, uncolored, conflicts) of a colouring of the n x n x n stencil."""
    a, b = (colors.select(F.col("idx").alias(x), F.col("color").alias(y)) for x, y in (("row", "p"), ("col", "q")))
    clash = Z.hpcg(spark, n).where("row <> col").join(a, "row").join(b, "col").agg(F.count(F.when(F.expr("p = q"), 1)).alias("conflicts"))
    return colors.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.expr("color is null or color < 1"), 1)).alias("uncolored")).join(clash, F.lit(True))


def _coloring(kind: str) -> Query:
    return lambda spark, d: _proper(spark, G.colored(G.symmetrized(G.graph(Z.hpcg(spark, 5))), kind), 5)


_QUERIES["color_hybrid"], _SQL["color_hybrid"] = _coloring("hybrid"), "SELECT 125::BIGINT AS nodes, 0::BIGINT AS uncolored, 0::BIGINT AS conflicts"


# colours in turn: inner points have 26 neighbours, so there are 27 colours
@query(_FIRST_FIT.replace("(SELECT min(k) FROM range(1, 40) t(k) WHERE k NOT IN", "(SELECT min_by((cs[-1] + k) % 27 + 1, k) FROM range(0, 27) t(k) WHERE (cs[-1] + k) % 27 + 1 NOT IN"))
def color_cyclic(spark, d):
    return G.colored(G.symmetrized(G.graph(Z.hpcg(spark, 4))), "cyclic")


@query("SELECT 125::BIGINT AS nodes, 0::BIGINT AS uncolored, 0::BIGINT AS conflicts")
def color_parallel(spark, d):
    return _proper(spark, G.colored_parallel(G.symmetrized(G.graph(Z.hpcg(spark, 5)))), 5)


@query(_FIRST_FIT.split("SELECT (generate")[0] + ", l AS (SELECT generate_subscripts(cs, 1) - 1 AS idx, unnest(cs) AS color FROM c WHERE i = 63), o AS (SELECT idx, row_number() OVER (ORDER BY color, idx) - 1 AS new FROM l) SELECT r.new AS row, q.new AS col, h.val FROM h JOIN o r ON h.row = r.idx JOIN o q ON h.col = q.idx")
def mc_reorder(spark, d):
    return G.multicolor(Z.hpcg(spark, 4))[0]


@query(f"WITH {_stencil(6)} SELECT DISTINCT row // 8 + 1 AS bsrc, col // 8 + 1 AS bdst FROM h")
def block_graph(spark, d):
    return G.block_graph(G.graph(Z.hpcg(spark, 6)), G.simple_blocks(spark.range(216).withColumnRenamed("id", "idx"), 8))


@query(f"WITH {_stencil(6)} SELECT DISTINCT row // 8 + 1 AS bsrc, col // 8 + 1 AS bdst FROM h WHERE row % 8 = col % 8")
def pseudo_block_graph(spark, d):
    return G.block_graph(G.graph(Z.hpcg(spark, 6)), G.simple_blocks(spark.range(216).withColumnRenamed("id", "idx"), 8), True)


@query("SELECT CASE WHEN range < 15 THEN 14 ELSE 6 END::BIGINT AS members, (range + 1)::BIGINT AS block FROM range(16)")
def connected_blocks(spark, d):
    return G.connected_blocks(G.graph(Z.hpcg(spark, 6)), 14).groupBy("block").agg(F.count(F.lit(1)).alias("members"))


@query("SELECT range AS part, 72::BIGINT AS nodes FROM range(3)")
def kway_parts(spark, d):
    return G.k_way(G.graph(Z.hpcg(spark, 6)), 3, separator=False).groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT 216::BIGINT AS nodes, 0::BIGINT AS cut_edges")
def kway_separator(spark, d):
    part = G.k_way(G.graph(Z.hpcg(spark, 6)), 3)
    a, b = (part.select(F.col("idx").alias(x), F.col("part").alias(y)) for x, y in (("row", "p"), ("col", "q")))
    cuts = Z.hpcg(spark, 6).join(a, "row").join(b, "col").agg(F.count(F.when(F.expr("p <> q and p < 3 and q < 3"), 1)).alias("cut_edges"))
    return part.agg(F.count(F.lit(1)).alias("nodes")).join(cuts, F.lit(True))


# ---- triangular solves, factors, preconditioners (identities)

_ONE_UP = "SELECT range AS idx, (range + 1)::DOUBLE AS val FROM range({n})"


def _blocked(spark: SparkSession, n: int, blocks: int, beta: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Diagonal blocks of the scaled stencil, and idx + 1 by block."""
    a = X.block_diagonal(X.scaled_symmetric(Z.stencil27(spark, n, n, n, beta)), n**3, blocks)
    return a, Z.iota(spark, n**3, 1).select(X.block_of(F.col("idx"), n**3, blocks).alias("block"), "idx", "val")


def _rounded(v: DataFrame) -> DataFrame:
    return v.select("idx", F.round("val", 6).alias("val"))


@query(_ONE_UP.format(n=216))
def trsv_direct(spark, d):
    a, b = _blocked(spark, 6, 1)
    low = a.where("col <= row")
    return _rounded(S.spmv(low, B.solve_lower(low, b, unit=False)))


@query(_ONE_UP.format(n=216))
def trsv_bj(spark, d):
    a, b = _blocked(spark, 6, 7)
    up = a.where("col >= row")
    return _rounded(S.spmv(up, B.solve_upper(up, b)))


@query(_ONE_UP.format(n=125))
def trsv_jacobi(spark, d):
    low = X.scaled_symmetric(Z.hpcg(spark, 5)).where("col <= row")
    return _rounded(S.spmv(low, P.damped_jacobi_solve(low, Z.iota(spark, 125, 1), 24)))


@query(_ONE_UP.format(n=125))
def trsv_jacobi_sell(spark, d):
    """The same sweeps over slices: padding is zero, so a product of slices is enough."""
    low = X.scaled_symmetric(Z.hpcg(spark, 5)).where("col <= row")
    return _rounded(S.spmv(low, P.damped_jacobi_solve(T.sell(low, 8, right=True), Z.iota(spark, 125, 1), 24)))


@query(_ONE_UP.format(n=125))
def trsv_jacobi_sell_upper(spark, d):
    up = X.scaled_symmetric(Z.hpgmp(spark, 5)).where("col >= row")
    return _rounded(S.spmv(up, P.damped_jacobi_solve(T.sell(up, 8), Z.iota(spark, 125, 1), 40, 0.8)))


def _tiled(a: DataFrame, blocks: int, n: int) -> DataFrame:
    """Tiles of 4 x 2 of (block, row, col, val), by block."""
    rows = F.col("brow") * 4
    return T.bcsr(a, 4, 2).withColumn("block", X.block_of(rows, n, blocks, 4))


def _tile_solve(blocks: int, lower: bool, unit: bool) -> Query:
    """T x of the solution of T x = idx + 1 by tiles, for a triangle T of each block."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        a = X.block_diagonal(X.scaled_symmetric(Z.hpgmp(spark, 6)), 216, blocks, 4)
        t = a.where("col <= row" if lower else "col >= row")
        b = Z.iota(spark, 216, 1).select(X.block_of(F.col("idx"), 216, blocks, 4).alias("block"), "idx", "val")
        x = B.solve_tiles(_tiled(t, blocks, 216), b, 4, 2, lower, unit)
        return _rounded(S.spmv(X.lower_unit(t) if unit else t, x))

    return run


for _name, _args in {"trsv_tiles_lower": (1, True, False), "trsv_tiles_unit": (1, True, True), "trsv_tiles_upper": (1, False, False), "trsv_bj_tiles": (6, True, False)}.items():
    _QUERIES[_name], _SQL[_name] = _tile_solve(*_args), _ONE_UP.format(n=216)


def _lu_on_pattern(f: DataFrame, a: DataFrame) -> DataFrame:
    lower = X.lower_unit(f.where("col <= row"))
    product = S.spgemm(lower, X.upper(f)).withColumnRenamed("val", "lu")
    return a.join(product, ["row", "col"], "left").select("row", "col", F.round("lu", 6).alias("lu"))


_BLOCKED = "WITH " + _stencil(5, 0.5) + ", s AS (SELECT row, col, val / 26.0 AS val FROM h WHERE least(row // 32, 3) = least(col // 32, 3)) SELECT row, col, round(val, 6) AS lu FROM s"


@query(_BLOCKED)
def ilu0_block(spark, d):
    a, _ = _blocked(spark, 5, 4)
    return _lu_on_pattern(B.ilu0(a), a)


@query(_BLOCKED)
def ilup(spark, d):
    a, _ = _blocked(spark, 5, 4)
    return _lu_on_pattern(B.ilup(a, 2), a)


@query(_BLOCKED)
def ilub(spark, d):
    a, _ = _blocked(spark, 5, 4)
    return _lu_on_pattern(B.ilu_tiles(a, 4, 2), a)


@query(f"WITH {_G}, {_X}, q AS (SELECT row, sum(val * val) AS q FROM g GROUP BY row) SELECT x.idx, round(g.val / q.q * x.val * 1e6, 6) AS val FROM g JOIN q ON g.row = q.row JOIN x ON x.idx = g.row WHERE g.row = g.col")
def spai0(spark, d):
    return P.spai0(gram_matrix(spark, d))(ones_up(spark, d)).select("idx", F.round(F.col("val") * 1e6, 6).alias("val"))


def _interpolated(choose: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Interior rows of the stencil sum to zero, so constants must be interpolated
    exactly there; every fine point depends on a coarse one."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        a = Z.hpcg(spark, 7)
        domain = spark.range(343).withColumnRenamed("id", "idx")
        points = written(choose(X.strong_weak(a).where("strong"), domain))
        p = A.interpolation(a, points)
        inside = spark.range(343).where("id % 7 between 1 and 5 and id div 7 % 7 between 1 and 5 and id div 49 between 1 and 5").withColumnRenamed("id", "row")
        sums = p.groupBy("row").agg(F.sum("val").alias("s")).join(inside, "row").agg(F.count(F.when(F.abs(F.col("s") - 1) > 0.05, 1)).alias("bad_rows"))
        lone = points.where("not coarse").join(p.select(F.col("row").alias("idx")).distinct(), "idx", "left_anti").agg(F.count(F.lit(1)).alias("lone_fine"))
        return points.agg(F.count(F.lit(1)).alias("points")).join(sums, F.lit(True)).join(lone, F.lit(True))

    return run


for _name, _choose in {"rs_interpolation": A.coarse_points, "rs_interpolation_parallel": A.coarse_points_parallel}.items():
    _QUERIES[_name], _SQL[_name] = _interpolated(_choose), "SELECT 343::BIGINT AS points, 0::BIGINT AS bad_rows, 0::BIGINT AS lone_fine"


# ---- solvers: A x is b


#: A residual whose norm is below this is below half a unit of the third decimal in every row.
_THREE_DECIMALS = 4e-4


def _solved(spark: SparkSession, solver: Callable[[FrameSpace], object], a: DataFrame, b: DataFrame, x: DataFrame | None = None, tol: float = 1e-7, space: Callable[[DataFrame, DataFrame], FrameSpace | GatheredSpace] = FrameSpace, least: float = np.inf, digits: int = 3) -> DataFrame:
    """A x and whether it is b: up to tol times the norm of b, and up to ``least``."""
    space = space(a, b.select("idx"))
    v = space.vector(b)
    norm = float(np.sqrt(space.dots((v, v))[0]))
    tol = min(tol, least / norm) if norm else tol
    s = solver(space)
    found, result = s.solve(v, None if x is None else space.vector(x), K.relative(norm, tol))
    return S.spmv(a, space.frame_of(found)).select("idx", F.round("val", digits).alias("val"), F.lit(result.solved).alias("solved"))


_SOLVED = f"WITH {_X} SELECT idx, val, true AS solved FROM x"


def _gram_solver(make: Callable[[FrameSpace, DataFrame], object]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = written(X.scaled_symmetric(gram_matrix(spark, d)))
        return _solved(spark, lambda s: make(s, g), g, ones_up(spark, d))

    return run


def _through(s: FrameSpace, m: P.Operator):
    return lambda v: s.through(m, v)


for _name, _make in {
    "cg": lambda s, g: K.CG(s, None, 60), "cr": lambda s, g: K.CR(s, None, 60), "gcr": lambda s, g: K.GCR(s, _through(s, P.jacobi(g)), 60),
    "bicgstab": lambda s, g: K.BiCGStab(s, None, 60), "fgmres": lambda s, g: K.FGMRES(s, _through(s, P.spai0(g)), 40),
    "fgmres_restarted": lambda s, g: K.Restarted(K.FGMRES(s, None, 8), 10),
    "auto_richardson": lambda s, g: K.Restarted(K.AdaptiveRichardson(s, None, 8, 1), 20),
}.items():
    _QUERIES[_name], _SQL[_name] = _gram_solver(_make), _SOLVED


@query(_SOLVED)
def richardson(spark, d):
    """Dozens of cheap steps: where the driver can hold a vector, a step is one job."""
    g = X.scaled_symmetric(written(gram_matrix(spark, d)))
    return _solved(spark, lambda s: K.Richardson(s, None, 80, 0.42), g, ones_up(spark, d), space=sized_space, least=_THREE_DECIMALS)


def _inverse_applied(follow_fill: bool) -> Query:
    """A M b.  Without dropping M is the exact inverse if it follows fill, and the first
    step is the last.  If it does not, M is exact only where no pair of suppliers is
    missing; what it leaves is corrected by further steps, until no row is off.

    Suppliers without a common order, direct or by others, do not meet in A, M or the
    steps, so each connected part is a task of its own that makes its matrix, too.
    A part that exceeds a task has its steps on the driver, by jobs, and M by blocks."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        n = supplier_index(spark, d).count()
        if n <= GATHERED:
            return _by_inverse_of_parts(order_lines(spark, d), ones_up(spark, d), follow_fill)
        g = X.scaled_symmetric(written(gram_matrix(spark, d)))
        m = P.ApproximateInverse(g, n, 1, 0.0, 1.0, follow_fill)
        return _by_inverse(spark, m, g, ones_up(spark, d))

    return run


def _by_inverse_of_parts(lines: DataFrame, b: DataFrame, follow_fill: bool, whole: int = B.WHOLE) -> DataFrame:
    t = b.select(F.col("idx").cast("long").alias("idx"), F.coalesce(F.col("val").cast("double"), F.lit(0.0)).alias("val")).where("idx is not null").toArrow()
    idx, first = np.unique(t.column("idx").to_numpy(), return_index=True)
    rhs = t.column("val").to_numpy()[first]

    def work(at: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray:
        return P.product_by_inverse(row, col, val, rhs[at], 1e-7, _THREE_DECIMALS / 10, follow_fill)

    parts = GP.GramParts(lines, idx)
    large, done = parts.sizes() > whole, None
    if large.any():
        y = P.products_by_blocks(parts, large, rhs, 1e-7, _THREE_DECIMALS / 10, follow_fill)
        if y is None:
            large[:] = False  # the whole inverse, in one task, may get there
        else:
            done = lines.sparkSession.createDataFrame(pa.table({"idx": idx[large], "val": y}))
    if not large.any():
        out = parts.per_part(~large, work)
    else:
        out = done if large.all() else parts.per_part(~large, work).unionByName(done)
    return out.select("idx", F.round("val", 4).alias("val"))


def _by_inverse(spark: SparkSession, m: P.ApproximateInverse, a: DataFrame, b: DataFrame) -> DataFrame:
    out = _solved(spark, lambda s: K.FGMRES(s, _through(s, m), 40), a, b, space=sized_space, least=_THREE_DECIMALS / 10, digits=4)
    return out.select("idx", F.when(F.col("solved"), F.col("val")).otherwise(F.raise_error(F.lit("the approximate inverse does not converge"))).alias("val"))


for _name, _follow in (("sdainv_apply", False), ("ainv_apply", True)):
    _QUERIES[_name], _SQL[_name] = _inverse_applied(_follow), f"WITH {_X} SELECT * FROM x"


# ---- a few steps of each solver against the same recurrence in SQL


class _Steps:
    """Common table expressions of a recurrence over state columns by idx: each step
    makes a new state from the last, from products and from dot products of it."""

    def __init__(self, **start: str):
        self.parts, self.n = [_D, _X, f"t0 AS MATERIALIZED (SELECT idx, {', '.join(f'{v} AS {c}' for c, v in start.items())} FROM x)"], 0
        self.columns = list(start)

    def step(self, **change: str) -> _Steps:
        """New or changed columns, from expressions over the last state's."""
        kept = [c for c in self.columns if c not in change]
        self._state(", ".join([*kept, *(f"{v} AS {c}" for c, v in change.items())]), f"t{self.n}", [*kept, *change])
        return self

    def product(self, out: str, of: str) -> _Steps:
        self.parts.append(f"m{self.n} AS MATERIALIZED (SELECT s.row AS idx, sum(s.val * t.{of}) AS {out} FROM s JOIN t{self.n} t ON s.col = t.idx GROUP BY s.row)")
        kept = [c for c in self.columns if c != out]
        self._state(", ".join([*kept, out]), f"(SELECT idx, {', '.join(kept)} FROM t{self.n}) JOIN m{self.n} USING (idx)", [*kept, out])
        return self

    def scalar(self, **sums: str) -> _Steps:
        """A number over all rows, kept as a column of every row."""
        kept = [c for c in self.columns if c not in sums]
        self._state(", ".join([*kept, *(f"(SELECT {v} FROM t{self.n}) AS {c}" for c, v in sums.items())]), f"t{self.n}", [*kept, *sums])
        return self

    def _state(self, columns: str, source: str, names: list[str]) -> None:
        self.n += 1
        self.parts.append(f"t{self.n} AS MATERIALIZED (SELECT idx, {columns} FROM {source})")
        self.columns = names

    def sql(self) -> str:
        return f"WITH {', '.join(self.parts)} SELECT idx, round(x, 5) AS x, round((SELECT sqrt(sum(r * r)) FROM t{self.n}) / (SELECT sqrt(sum(val * val)) FROM x), 6) AS res FROM t{self.n}"


def _steps_cg(n: int) -> str:
    s = _Steps(x="0.0::DOUBLE", r="val", p="val").scalar(rr="sum(r * r)")
    for _ in range(n):
        s.product("q", "p").scalar(a="any_value(rr) / sum(p * q)").step(x="x + a * p", r="r - a * q").scalar(new="sum(r * r)").step(p="r + new / rr * p", rr="new")
    return s.sql()


def _steps_cr(n: int) -> str:
    s = _Steps(x="0.0::DOUBLE", r="val", p="val").product("az", "r").step(q="az").scalar(za="sum(r * az)")
    for _ in range(n):
        s.scalar(a="any_value(za) / sum(q * q)").step(x="x + a * p", r="r - a * q").product("az", "r").scalar(new="sum(r * az)").step(p="r + new / za * p", q="az + new / za * q", za="new")
    return s.sql()


def _steps_bicgstab(n: int) -> str:
    s = _Steps(x="0.0::DOUBLE", r="val", p="val", w="val").scalar(rho="sum(w * r)")
    for _ in range(n):
        s.product("v", "p").scalar(a="any_value(rho) / sum(w * v)").step(h="r - a * v").product("t", "h").scalar(o="sum(t * h) / sum(t * t)")
        s.step(x="x + a * p + o * h", r="h - o * t").scalar(new="sum(w * r)").step(p="r + new / rho * a / o * (p - o * v)", rho="new")
    return s.sql()


def _steps_gcr() -> str:
    """Two steps: the second direction's image is made orthogonal to the first's."""
    s = _Steps(x="0.0::DOUBLE", r="val", u="val").product("c", "u").scalar(cc="sum(c * c)", rc="sum(r * c)").step(x="x + rc / cc * u", r="r - rc / cc * c")
    s.product("d", "r").scalar(f="sum(d * c) / any_value(cc)").step(u="r - f * u", d="d - f * c").scalar(cc="sum(d * d)", rc="sum(r * d)")
    return s.step(x="x + rc / cc * u", r="r - rc / cc * d").sql()


def _steps_richardson(n: int, omega: str) -> str:
    s = _Steps(x="0.0::DOUBLE", r="val")
    for _ in range(n):
        s.product("q", "r").scalar(o=omega).step(x="x + o * r", r="r - o * q")
    return s.sql()


def _first_steps(make: Callable[[FrameSpace], object]) -> Query:
    """(idx, x, res): the iterate after so many steps, and its relative residual."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g, b = written(X.scaled_symmetric(gram_matrix(spark, d))), ones_up(spark, d)
        space = FrameSpace(g, b.select("idx"))
        v = space.vector(b)
        x = space.frame_of(make(space).solve(v, None, lambda k, norm: False)[0])
        left = S.residual(g, x, b).join(b.select("idx", F.col("val").alias("b")), "idx")
        res = left.agg((F.sqrt(F.sum(F.col("val") * F.col("val"))) / F.sqrt(F.sum(F.col("b") * F.col("b")))).alias("res"))
        return x.join(res, F.lit(True)).select("idx", F.round("val", 5).alias("x"), F.round("res", 6).alias("res"))

    return run


for _name, (_make, _sql) in {
    "cg_steps": (lambda s: K.CG(s, None, 3), _steps_cg(3)), "cr_steps": (lambda s: K.CR(s, None, 3), _steps_cr(3)),
    "bicgstab_steps": (lambda s: K.BiCGStab(s, None, 2), _steps_bicgstab(2)), "gcr_steps": (lambda s: K.GCR(s, None, 2), _steps_gcr()),
    "fgmres_steps": (lambda s: K.FGMRES(s, None, 2), _steps_gcr()), "sgmres_steps": (lambda s: K.BasisFirstGMRES(s, None, 2), _steps_gcr()),
    "richardson_steps": (lambda s: K.Richardson(s, None, 3, 0.42), _steps_richardson(3, "max(0.42::DOUBLE)")),
    "auto_richardson_steps": (lambda s: K.AdaptiveRichardson(s, None, 3, 1), _steps_richardson(3, "sum(q * r) / sum(q * q)")),
}.items():
    _QUERIES[_name], _SQL[_name] = _first_steps(_make), _sql


@query("SELECT range AS idx, (range + 1)::DOUBLE AS val, true AS solved FROM range(343)")
def amg_vcycle(spark, d):
    a = written(Z.hpcg(spark, 7))
    m = A.AMG(a, spark.range(343).withColumnRenamed("id", "idx"), smallest=100)
    return _solved(spark, lambda s: K.CG(s, _through(s, m), 40), a, Z.iota(spark, 343, 1))


@query("SELECT range AS idx, (range + 1)::DOUBLE AS val, true AS solved FROM range(216)")
def block_ilu_cg(spark, d):
    a = written(X.scaled_symmetric(Z.hpcg(spark, 6)))
    m = P.BlockILU(a, 216, 4)
    return _solved(spark, lambda s: K.CG(s, _through(s, m), 60), a, Z.iota(spark, 216, 1))


@query("SELECT range AS idx, (range + 1)::DOUBLE AS val, true AS solved FROM range(216)")
def block_ilu_tiles_cg(spark, d):
    """Factors on the pattern of 3 x 3 tiles, with their fill."""
    a = written(X.scaled_symmetric(Z.hpcg(spark, 6)))
    m = P.BlockILU(a, 216, 4, unit=3, tile=3)
    return _solved(spark, lambda s: K.CG(s, _through(s, m), 60), a, Z.iota(spark, 216, 1))


@query("SELECT range AS idx, (range + 1)::DOUBLE AS val, true AS solved FROM range(125)")
def block_ilu_jacobi_cg(spark, d):
    """Block factors solved by Jacobi sweeps instead of substitution."""
    a = written(X.scaled_symmetric(Z.hpcg(spark, 5)))
    m = P.preconditioner("ilu", a, 125, blocks=4, triangular=P.jacobi_sweeps(3))
    return _solved(spark, lambda s: K.FGMRES(s, _through(s, m), 30), a, Z.iota(spark, 125, 1))


# ---- nested pipelines, one task a system


def _systems(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    a = Z.hpcg(spark, 6).withColumn("system", F.lit("hpcg")).unionByName(Z.hpgmp(spark, 6).withColumn("system", F.lit("hpgmp")))
    b = Z.iota(spark, 216, 1).select(F.explode(F.array(F.lit("hpcg"), F.lit("hpgmp"))).alias("system"), "idx", "val")
    return a, b


_PAIR = "SELECT s AS system, range AS idx, (range + 1)::DOUBLE AS ax, true AS solved FROM range(216), (VALUES ('hpcg'), ('hpgmp')) t(s)"


def _nested(config: N.Config, spd_only: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = _systems(spark)
        if spd_only:
            a, b = a.where("system = 'hpcg'"), b.where("system = 'hpcg'")
        x = written(N.solve_systems(a, b, config))
        done = x.groupBy("system").agg(F.min("solved").alias("solved"))
        scaled = a.withColumn("val", F.col("val") / 26.0)  # all diagonals are 26
        ax = scaled.join(x.select("system", F.col("idx").alias("col"), "x"), ["system", "col"]).groupBy("system", F.col("row").alias("idx")).agg(F.round(F.sum(F.col("val") * F.col("x")), 3).alias("ax"))
        return ax.join(done, "system")

    return run


for _name, _config in {
    "f3r_fp64": N.Config(), "f3r_fp32": N.Config(precision="float"), "f3r_fp16": N.Config(precision="half"),
    "f3r_static": N.Config("static", "half", omega=0.9), "f3r_sdainv": N.Config(precision="float", preconditioner="sdainv"),
    "f3r_sdainv_fp64": N.Config(preconditioner="sdainv"), "f3r_sdainv_fp16": N.Config(precision="half", preconditioner="sdainv"),
    "gmres_sdainv": N.Config("gmres", "float", preconditioner="sdainv"), "bicgstab_sdainv": N.Config("bicgstab", "half", preconditioner="sdainv"),
    "depth_f2": N.Config("f2", "float"), "depth_f2h": N.Config("f2h", "half"), "depth_f3": N.Config("f3", "half"),
    "depth_f3h": N.Config("f3h", "half"), "depth_f4": N.Config("f4", "half"), "pipeline_gmres": N.Config("gmres"), "pipeline_bicgstab": N.Config("bicgstab"),
}.items():
    _QUERIES[_name], _SQL[_name] = _nested(_config), _PAIR
_QUERIES["pipeline_cg"], _SQL["pipeline_cg"] = _nested(N.Config("cg"), True), _PAIR.replace("('hpcg'), ('hpgmp')", "('hpcg')")


_QUERIES["cg_sdainv"], _SQL["cg_sdainv"] = _nested(N.Config("cg", "half", preconditioner="sdainv"), True), _SQL["pipeline_cg"]


@query(f"WITH {_stencil(6)} SELECT s AS system, count(*) AS entries, 0::BIGINT AS off_grid, true AS near FROM h, (VALUES ('hpcg'), ('hpgmp')) t(s) WHERE least(row // 54, 3) = least(col // 54, 3) GROUP BY s")
def factor_fp16(spark, d):
    """Factors kept in half precision: all values are multiples of 2^-10 of their
    leading power of two, and L U is the scaled matrix, on its pattern, up to them."""
    a = _systems(spark)[0]
    f = written(N.factors(a, 4, "half"))
    grid = F.pow(F.lit(2.0), F.floor(F.log2(F.abs("val"))) - 10)
    on_grid = f.groupBy("system").agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("val") / grid != F.rint(F.col("val") / grid), 1)).alias("off_grid"))
    lower = X.lower_unit(f.where("col <= row")).select("system", "row", F.col("col").alias("k"), F.col("val").alias("l"))
    up = f.where("col >= row").select("system", F.col("row").alias("k"), "col", F.col("val").alias("u"))
    lu = lower.join(up, ["system", "k"]).groupBy("system", "row", "col").agg(F.sum(F.col("l") * F.col("u")).alias("lu"))
    off = a.join(lu.join(f.select("system", "row", "col"), ["system", "row", "col"]), ["system", "row", "col"])
    near = off.groupBy("system").agg((F.max(F.abs(F.col("lu") - F.col("val") / 26.0)) < 2.0**-9).alias("near"))
    return on_grid.join(near, "system")


def _report_configs() -> dict[str, N.Config]:
    return {"F3R": N.Config(precision="half"), "CG": N.Config("cg"), "GMRES": N.Config("gmres", "float"), "BiCGStab": N.Config("bicgstab"), "F3R-Static": N.Config("static", "float", omega=0.9), "F4": N.Config("f4", "half")}


@query("""SELECT 'hpcg' AS Problem, * FROM (VALUES ('F3R', '_Float16', 8, 4, 2, 64.0), ('CG', 'double', 0, 0, 0, 0.0), ('GMRES', 'float', 0, 0, 0, 0.0), ('BiCGStab', 'double', 0, 0, 0, 0.0),
('F3R-Static', 'float', 8, 4, 2, 0.9), ('F4', '_Float16', 0, 0, 0, 0.0)) t(Method, Prec, M2, M3, M4, W), (SELECT 'BJILU0' AS Precond, 1.0::DOUBLE AS ACC, true AS timed, true AS iterated, true AS implicit, true AS explicit)""".replace("SELECT 'hpcg' AS Problem, *", "SELECT 'hpcg' AS Problem, Method, Prec, M2::BIGINT AS M2, M3::BIGINT AS M3, M4::BIGINT AS M4, W::DOUBLE AS W, Precond, ACC, timed, iterated, implicit, explicit"))
def solve_report(spark, d):
    """Result rows of one system by six methods: a preconditioner is called 64 times a
    step of F3R and of F4, and no method needs 130 calls or leaves 1e-8."""
    a, b = (x.where("system = 'hpcg'") for x in _systems(spark))
    out = None
    for config in _report_configs().values():
        rows = N.report_rows(N.run_systems(a, b, config, 2), config)
        out = rows if out is None else out.unionByName(rows)
    calls = F.when(F.col("Method").isin("F3R", "F3R-Static", "F4"), F.col("Iter") % 64 == 0).otherwise(True)
    out = out.withColumn("timed", F.col("Time") > 0).withColumn("iterated", calls & F.col("Iter").between(1, 192))
    return out.withColumn("implicit", F.col("ImplRes") < 1e-8).withColumn("explicit", F.col("ExplRes") < 2e-8).drop("Time", "Iter", "ImplRes", "ExplRes")


@query("SELECT s AS system, true AS starts, true AS numbered, true AS falls, true AS ends FROM (VALUES ('hpcg'), ('hpgmp')) t(s)")
def convergence_log(spark, d):
    """What GMRES(64) logs: 1 at step 0, never rising, below 1e-8 at the end only."""
    log = N.convergence(*_systems(spark), N.Config("gmres"))
    before = F.lag("relres").over(Window.partitionBy("system").orderBy("step"))
    log = log.withColumn("rise", F.col("relres") > before * (1 + 1e-12))
    return log.groupBy("system").agg(
        (F.max(F.when(F.col("step") == 0, F.round("relres", 12))) == 1).alias("starts"), (F.max("step") + 1 == F.count(F.lit(1))).alias("numbered"),
        (F.count(F.when(F.col("rise"), 1)) == 0).alias("falls"), ((F.count(F.when(F.col("relres") < 1e-8, 1)) == 1) & (F.max_by("relres", "step") < 1e-8)).alias("ends"),
    )


@query("SELECT range AS idx, (range + 1)::DOUBLE AS re, (range % 3)::DOUBLE AS im FROM range(125)")
def cocg_complex(spark, d):
    """(A + 5 i I) x for the solution of a complex symmetric system, in one task."""
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        row, col, val = (t.column(c).to_numpy() for c in ("row", "col", "val"))
        n = int(row.max()) + 1

        def apply(v: np.ndarray) -> np.ndarray:
            p = val * v[col]
            return np.bincount(row, p.real, n) + 1j * np.bincount(row, p.imag, n) + 5j * v

        b = (np.arange(n) + 1) + 1j * (np.arange(n) % 3)
        x, _ = K.cocg(apply, b, K.relative(float(np.linalg.norm(b)), 1e-10))
        ax = apply(x)
        return pa.table({"idx": np.arange(n), "re": np.round(ax.real, 4) + 0.0, "im": np.round(ax.imag, 4) + 0.0})

    return Z.hpcg(spark, 5).withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(run, "idx long, re double, im double")


# ---- reports, over result rows derived from orders


def _results(spark: SparkSession, d: str) -> DataFrame:
    """A result row for every customer (problem) and priority (method)."""
    o = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("Problem"), F.substring("o_orderpriority", 1, 1).alias("Tag"))
    out = o.agg(F.sum(F.floor("o_totalprice")).cast("double").alias("Time"), F.count(F.lit(1)).alias("Iter"), F.min("o_orderkey").alias("line"))
    res = F.when(F.col("line") % 11 == 0, F.lit(float("nan"))).when(F.col("line") % 5 == 0, 1e-3).otherwise(1e-9)
    return out.withColumn("ImplRes", res)


_R = "r AS (SELECT 'c' || o_custkey AS Problem, substr(o_orderpriority, 1, 1) AS Tag, sum(floor(o_totalprice))::DOUBLE AS Time, count(*) AS Iter, min(o_orderkey) AS line FROM orders GROUP BY ALL), q AS (SELECT *, CASE WHEN line % 11 = 0 THEN 'nan'::DOUBLE WHEN line % 5 = 0 THEN 1e-3::DOUBLE ELSE 1e-9::DOUBLE END AS ImplRes FROM r)"
_BASED = _R + ", t AS (SELECT Problem, max(Time) AS base FROM q WHERE Tag = '1' GROUP BY Problem)"


def _with_baseline(df: DataFrame) -> DataFrame:
    return df.join(df.where("Tag = '1'").select("Problem"), "Problem", "left_semi")


@query(f"WITH {_BASED} SELECT q.Problem, q.Tag, CASE WHEN NOT isnan(ImplRes) AND ImplRes <= 1e-8 THEN base / Time END AS Speedup FROM q JOIN t USING (Problem) WHERE q.Tag <> '1'")
def report_speedup(spark, d):
    return R.masked(R.versus_baseline(_with_baseline(_results(spark, d)), "1", "Time", "Speedup"), "Speedup").select("Problem", "Tag", "Speedup")


@query(f"WITH {_BASED} SELECT q.Problem, q.Tag, CASE WHEN NOT isnan(ImplRes) AND ImplRes > 1e-8 THEN 0.0 ELSE base / Time END::DOUBLE AS RelSpeed FROM q JOIN t USING (Problem) WHERE q.Tag <> '1'")
def report_relative(spark, d):
    return R.masked(R.versus_baseline(_with_baseline(_results(spark, d)), "1", "Time", "RelSpeed"), "RelSpeed", zero=True).select("Problem", "Tag", "RelSpeed")


@query(f"WITH {_R} SELECT Problem, Tag, CASE WHEN NOT isnan(ImplRes) AND ImplRes <= 1e-8 THEN Time END AS Time FROM q")
def report_mask(spark, d):
    return R.masked(_results(spark, d), "Time").select("Problem", "Tag", "Time")


@query(f"WITH {_R} SELECT Problem, max(Iter) FILTER (Tag = '1') AS \"1\", max(Iter) FILTER (Tag = '2') AS \"2\", max(Iter) FILTER (Tag = '3') AS \"3\" FROM q WHERE Tag IN ('1', '2', '3') GROUP BY Problem")
def report_table_pivot(spark, d):
    r = _results(spark, d)
    return R.pivoted([r.where("Tag < '3'"), r.where("Tag >= '3'")], ["1", "2", "3"])


@query(f"WITH {_R}, k AS (SELECT *, row_number() OVER (ORDER BY line) - 1 AS n FROM q) SELECT Problem, Tag FROM k WHERE n % 3 = 0")
def report_sample(spark, d):
    return R.systematic(_results(spark, d), 3).select("Problem", "Tag")


@query("WITH l AS (SELECT DISTINCT l_partkey % 12 || '-' || l_linenumber || '-' || l_suppkey % 4 AS Tag FROM lineitem) SELECT 'm4' AS sweep, Tag FROM l WHERE regexp_matches(Tag, '^8-4-[0-9]+$') UNION ALL SELECT 'm3', Tag FROM l WHERE regexp_matches(Tag, '^8-[0-9]+-2$') UNION ALL SELECT 'm2', Tag FROM l WHERE regexp_matches(Tag, '^[0-9]+-4-2$')")
def report_sweeps(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_partkey") % 12).alias("M2"), F.col("l_linenumber").alias("M3"), (F.col("l_suppkey") % 4).alias("M4"))
    tags = R.tagged(l, "M2", "M3", "M4").select("Tag").distinct()
    parts = [R.sweep(tags, k).select(F.lit(k).alias("sweep"), "Tag") for k in R.SWEEPS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH l AS (SELECT event_id AS line, user_id, event_id % 13 AS k FROM events),
r AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (ORDER BY line) AS run, last_value(CASE WHEN k = 0 THEN 'p' || user_id END IGNORE NULLS) OVER (ORDER BY line) AS problem FROM l)
SELECT problem, run::BIGINT AS run, k::INTEGER AS step, CASE WHEN k = 0 THEN 1.0 ELSE 1.0 / k END::DOUBLE AS relres FROM r WHERE run > 0 AND k <> 1
UNION ALL SELECT problem, run::BIGINT, 1, 1.0::DOUBLE FROM r WHERE run > 0 AND k = 1""")
def report_log_parse(spark, d):
    return R.parsed_log(_log_lines(spark, d), ["p"])


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log of the events: every thirteenth opens a run, the others are its steps."""
    k = F.col("event_id") % 13
    value = F.when(k == 0, F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit(",F3R"))).otherwise(F.concat_ws(" ", k.cast("string"), (F.lit(1.0) / F.when(k == 0, 1).otherwise(k)).cast("string")))
    return table(spark, d, "events").select(F.col("event_id").alias("line"), value.alias("value"))


@query(_SQL["report_log_parse"])
def report_log_file(spark, d):
    """The same log, written to a file of several parts and read by position."""
    path = _file(spark, "log.txt")
    _log_lines(spark, d).repartitionByRange(3, "line").sortWithinPartitions("line").select("value").write.text(path)
    return R.read_log(spark, path, ["p"])


@query("SELECT problem, program, m2, m3, m4 FROM (VALUES ('a'), ('b')) p(problem), (VALUES ('f3r'), ('cg')) e(program), (VALUES (8, 4, 2), (10, 4, 2), (8, 3, 2)) g(m2, m3, m4)")
def parameter_sweep(spark, d):
    return R.parameter_sweep(spark, ["a", "b"], ["f3r", "cg"], [(8, 4, 2), (10, 4, 2), (8, 3, 2)])


@query("SELECT platform, \"symmetric\", place::INTEGER AS place, problem, acc::DOUBLE AS acc, m2::INTEGER AS m2, m3::INTEGER AS m3, m4::INTEGER AS m4 FROM (VALUES " + ", ".join(str((p, y, i, *[x if j == 0 else float(x) if j == 1 else int(x) for j, x in enumerate(c.split())])) for (p, y), t in R.CATALOGUE.items() for i, c in enumerate(t.split(","))) + ") t(platform, \"symmetric\", place, problem, acc, m2, m3, m4)")
def problem_catalogue(spark, d):
    return R.problem_catalogue(spark)


@query(f"""WITH {_R}, k AS (SELECT Problem, max(Iter) FILTER (Tag = '1') AS a, max(Iter) FILTER (Tag = '2') AS b FROM q WHERE Tag IN ('1', '2') GROUP BY Problem),
s AS (SELECT Problem, coalesce(a::VARCHAR, 'NaN') AS a, coalesce(b::VARCHAR, 'NaN') AS b FROM k), w AS (SELECT greatest(max(length(Problem)), 7) AS p, greatest(max(length(a)), 1) AS a, greatest(max(length(b)), 1) AS b FROM s)
SELECT lpad(Problem, p::INTEGER, ' ') || ' ' || lpad(s.a, w.a::INTEGER, ' ') || ' ' || lpad(s.b, w.b::INTEGER, ' ') AS line FROM s, w""")
def report_text(spark, d):
    r = _results(spark, d)
    return R.text_lines(R.pivoted([r.where("Tag in ('1', '2')")], ["1", "2"]), ["Problem", "1", "2"])


@query("SELECT l_orderkey AS Problem, avg(l_quantity) AS Time, sum(l_linenumber) // count(*) AS Iter FROM lineitem GROUP BY l_orderkey")
def repetition_means(spark, d):
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("Problem"), F.col("l_quantity").alias("Time"), F.col("l_linenumber").cast("long").alias("Iter"))
    return R.mean_of_repetitions(runs, ["Problem"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
