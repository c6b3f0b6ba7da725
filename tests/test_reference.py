"""Registered queries against their SQL in DuckDB, and the kernels against numpy."""

import os
import time
from urllib.parse import urlparse

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import spandrel.queries as Q
from spandrel.functions import vec as V
from spandrel.meta import MatrixMeta, SolveResult
from spandrel.operators import blocks as B
from spandrel.operators import formats as T
from spandrel.operators import kernels as K
from spandrel.operators import parts as GP
from spandrel.operators import spmat as S
from spandrel.operators import structure as X
from spandrel.plans import amg, krylov, nested, precond, report
from spandrel.plans.spaces import Coefficients, FrameSpace, GatheredSpace, LocalSpace, sized_space
from spandrel.session import ranked, shared_folder, written
from spandrel.sources import matrix_market as M
from spandrel.sources import stencils as Z

SF = "/root/testdata/sf0.001"
#: Queries that take long through many small jobs; the driver's comparison runs them too.
FAST = [n for n in Q.oracle_sql() if n not in ("cr", "gcr", "bicgstab", "fgmres", "fgmres_restarted", "richardson", "auto_richardson", "amg_vcycle", "block_ilu_cg", "color_parallel", "block_ilu_tiles_cg", "color_greedy_rounds", "block_ilu_jacobi_cg", "sgmres_steps", "rs_interpolation_parallel", "trsv_jacobi_sell", "trsv_jacobi_sell_upper")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    return ("nan" if v != v else v + 0.0) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_coarse_points_of_large_patterns(spark):
    """Beyond the bound the choice is made in rounds: coarse points do not depend on each
    other unless the last pass added one, every fine point with a strong neighbour has a
    coarse one or is one on which nothing depends."""
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (200, 2)) if a != b})
    strong = spark.createDataFrame(edges, "row long, col long")
    domain = spark.range(64).withColumnRenamed("id", "idx")
    assert amg.coarse_points(strong, domain, len(edges) + 64).where("coarse").count() == len(K.coarse_points(K.adjacency([], [], range(64)) | {n: {b for a, b in edges if a == n} for n in range(64)}))
    got = {r.idx: r.coarse for r in amg.coarse_points(strong, domain, 0).collect()}
    coarse, depended = {i for i, c in got.items() if c}, {b for _, b in edges}
    of = {n: {b for a, b in edges if a == n} for n in range(64)}
    assert got.keys() == set(range(64)) and coarse
    assert all(n in coarse or not of[n] or of[n] & coarse or n not in depended for n in range(64))
    assert not any(n not in coarse and m not in coarse and m > n and not of[n] & of[m] & coarse for n in of for m in of[n])


def test_graph_takes_every_part(spark):
    want = {(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    got = [(r.src, r.dst) for r in Q.queries()["graph_symmetrize"](spark, SF).collect()]
    assert len(got) == 2 * len(want) and {(a // 2, b // 2) for a, b in got if a % 2 == 0} == want


def test_arithmetic_takes_every_customer(spark):
    want = {r.c_custkey: r.c_acctbal for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    got = {r.idx: r.div for r in Q.queries()["vec_arith"](spark, SF).collect()}
    zeros = [k for k in want if k % 7 == 0]
    assert got.keys() == want.keys() and zeros
    assert all(got[k] == np.copysign(np.inf, want[k]) if want[k] else np.isnan(got[k]) for k in zeros)


# sources


def write(path, text):
    path.write_text(text)
    return str(path)


def test_matrix_market(spark, tmp_path):
    p = write(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 5\n1 1 0.0\n2 1 2.5\n3 1 0.0\n3 3 5\n2 2 -1\n")
    a, meta = M.read_matrix(spark, p)
    assert sorted(map(tuple, a.collect())) == [(0, 0, 0.0), (0, 1, 2.5), (1, 0, 2.5), (1, 1, -1.0), (2, 2, 5.0)]
    assert (meta.nrows, meta.is_symmetric) == (3, True)
    _, _, b = M.read_system(spark, p, lambda n: Z.filled(spark, n, 1.0))
    assert b.count() == 3
    write(tmp_path / "a_b.mtx", "%%MatrixMarket matrix array real general\n3 1\n1\n2\n3\n")
    assert sorted(map(tuple, M.read_system(spark, p, None)[2].collect())) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    M.write_matrix(a, meta, str(tmp_path / "out"))
    assert sorted(map(tuple, M.read_matrix(spark, str(tmp_path / "out"))[0].collect())) == sorted(map(tuple, a.where("row = col or val <> 0").collect()))
    c, _ = M.read_matrix(spark, write(tmp_path / "c.mtx", "%%MatrixMarket matrix coordinate complex general\n2 2 2\n1 1 1 2\n2 1 0 -1\n"), True)
    assert sorted((r.row, r.col, r.val.re, r.val.im) for r in c.collect()) == [(0, 0, 1.0, 2.0), (1, 0, 0.0, -1.0)]
    for head in ("pattern general", "real skew-symmetric"):
        with pytest.raises(ValueError):
            M.read_matrix(spark, write(tmp_path / "bad.mtx", f"%%MatrixMarket matrix coordinate {head}\n1 1 1\n1 1 1\n"))


def test_files_in_several_parts(spark, tmp_path):
    """Writers make parts that read as one; positions follow the parts' names."""
    a = spark.range(0, 5000, 1, 7).select((F.col("id") % 50).alias("row"), F.expr("id div 50").alias("col"), (F.col("id") + 0.5).alias("val"))
    M.write_matrix(a, MatrixMeta(50, 100), str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("part*"))) > 3
    text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part*")))
    assert text.startswith("%%MatrixMarket matrix coordinate real general\n50 100 5000\n")
    got, meta = M.read_matrix(spark, str(tmp_path / "a"))
    assert (meta.nrows, meta.ncols) == (50, 100) and sorted(map(tuple, got.collect())) == sorted(map(tuple, a.collect()))
    v = spark.range(0, 3000, 1, 5).select(F.col("id").alias("idx"), (F.lit(9.0) - F.col("id")).alias("val"))
    M.write_vector(v, 3000, str(tmp_path / "v"))
    assert sorted(map(tuple, M.read_vector(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, v.collect()))
    square = a.where("col < 50").unionByName(spark.createDataFrame([(3, 60, 1.0)], "row long, col long, val double")).where("row <> 7")
    b = Z.iota(spark, 50, 1)
    M.write_index_coefficients(square, b, 50, str(tmp_path / "sys_00000001"))
    got, meta, rhs = M.read_index_coefficients(spark, str(tmp_path / "sys_00000001"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, square.collect()))
    assert sorted(map(tuple, rhs.collect())) == sorted(map(tuple, b.collect()))


def test_ranks_and_orders_in_runs(spark):
    rng = np.random.default_rng(4)
    keys = sorted(set(rng.integers(-10**6, 10**6, 3000).tolist()))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert {r.k: r.n for r in ranked(df, "k", "n", 1000).collect()} == {k: i for i, k in enumerate(keys)}
    colors = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.integers(1, 4, 500))], "idx long, color long")
    want = [r.idx for r in sorted(colors.collect(), key=lambda r: (r.color, r.idx))]
    assert [r.old for r in sorted(X.ordered_by(colors, size=16).collect())] == want


def test_log_across_runs_of_lines(spark, monkeypatch):
    monkeypatch.setattr(report, "LOG_RUN", 3)
    lines = ["noise", "pa,x", "1 0.5", "2 0.25", "3 0.125", "4 0.1", "5 0.01", "6 0.001", "pb,x", "1 0.5", "pc,x", "pd,x", "1 0.1"]
    log = report.parsed_log(spark.createDataFrame(list(enumerate(lines)), "line long, value string"), ["p"])
    got = sorted((r.problem, r.run, r.step) for r in log.collect())
    assert got == [("pa", 1, k) for k in range(7)] + [("pb", 2, 0), ("pb", 2, 1), ("pc", 3, 0), ("pd", 4, 0), ("pd", 4, 1)]


def test_stable_order(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 3, "y"), ("b", 0, "z"), ("a", 2, "w")], "Problem string, line long, v string")
    assert [r.v for r in report.stable_by_problem(df).collect()] == ["w", "y", "z", "x"]


def test_text_table(spark):
    df = spark.createDataFrame([("a", 1.5), ("long name", None)], "Problem string, x double")
    assert report.text_heading(df, ["Problem", "x"]) == "  Problem   x"
    assert sorted(r.line for r in report.text_lines(df, ["Problem", "x"]).collect()) == ["        a 1.5", "long name NaN"]


def test_index_coefficient_pair(spark, tmp_path):
    write(tmp_path / "sys_index_0001.dat", "3 4 0 0\n1 2 3\n1 9 9 9\n1 3 4\n")
    write(tmp_path / "sys_coeff_0001.dat", "1.5 2 3 4\n10 20 30\n")
    a, meta, b = M.read_index_coefficients(spark, str(tmp_path / "sys_0001.dat"))
    assert sorted(map(tuple, a.collect())) == [(0, 0, 1.5), (0, 1, 2.0), (1, 2, 3.0), (2, 0, 4.0)]
    assert sorted(map(tuple, b.collect())) == [(0, 10.0), (1, 20.0), (2, 30.0)] and meta.nrows == 3


def test_results_and_logs(spark, tmp_path):
    head = ",".join(report.FIELDS)
    rows = ["p,F3R,double,8,4,2,64,B,1.0,4.0,10,1e-9,1e-9", "p,CG,_Float16,0,0,0,0,B,1.0,2.0,20,1e-9,1e-9", "p,CG,float,0,0,0,0,B,1.0,1.0,20,1e-3,nan", "p,GMRES,__half,0,0,0,0,B,1.0,1.0,20,-nan,inf"]
    df = report.tagged(report.named_best(report.read_results(spark, write(tmp_path / "r.csv", "\n".join([head, *rows])))), "Method", "Prec")
    out = {r.Tag: r.s for r in report.masked(report.versus_baseline(df, "F3R-double", "Time", "s"), "s").collect()}
    assert out == {"CG-Best": 2.0, "CG-float": None, "GMRES-Best": None}
    out = {r.Tag: r.s for r in report.masked(report.versus_baseline(df, "F3R-double", "Time", "s"), "s", zero=True).collect()}
    assert out == {"CG-Best": 2.0, "CG-float": 0.0, "GMRES-Best": 4.0}
    with pytest.raises(Exception, match="no single baseline"):
        report.versus_baseline(df, "absent", "Time", "s").collect()
    with pytest.raises(Exception, match="twice"):
        report.pivoted([df, df], ["CG-Best"]).collect()
    report.write_results(df, str(tmp_path / "w"))
    assert report.read_results(spark, str(tmp_path / "w")).count() == 4
    log = report.read_log(spark, write(tmp_path / "l.txt", "noise\natmosmodd,F3R\n0 1.0\n1 0.5\n2 nan\nvas_stokes_2M,CG\n1 1e-3\n"), ["atmosmodd", "vas_stokes_2M"])
    got = sorted((r.problem, r.run, r.step, str(r.relres), r.x, r.label) for r in report.with_labels(report.log_axis(log), ["a", "b"]).collect())
    assert got == [("atmosmodd", 1, 0, "1.0", 0, "a"), ("atmosmodd", 1, 1, "0.5", 64, "a"), ("atmosmodd", 1, 2, "nan", 128, "a"), ("vas_stokes_2M", 2, 0, "1.0", 0, "b"), ("vas_stokes_2M", 2, 1, "0.001", 64, "b")]
    assert {r.Label for r in report.labelled(df, {"CG-Best": "best"}).collect()} == {"best", "F3R-double", "CG-float", "GMRES-Best"}


# edge cases of frames


def frame(spark, dense):
    rows = [(i, j, float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "row long, col long, val double")


def test_empty_rows_duplicates_and_tiles(spark):
    a = frame(spark, [[1, 0, 2, 0, 0], [0, 0, 0, 0, 0], [0, 3, 0, 0, 4], [5, 0, 0, 0, 0], [0, 0, 0, 0, 6]])
    x = Z.iota(spark, 5, 1)
    want = {0: 7.0, 1: 0.0, 2: 26.0, 3: 5.0, 4: 30.0}
    assert dict(map(tuple, S.spmv(a, x, spark.range(5).withColumnRenamed("id", "idx")).collect())) == want
    assert dict(map(tuple, S.spmv(a.unionByName(a), x).collect())) == {k: 2 * v for k, v in want.items() if v}
    tiles = T.bcsr(a, 2, 3)
    assert sorted(map(tuple, T.from_bcsr(tiles, 2, 3).where("val <> 0").collect())) == sorted(map(tuple, a.collect()))
    assert {k: v for k, v in map(tuple, T.spmv_bcsr(tiles, x, 2, 3).collect()) if v} == {k: v for k, v in want.items() if v}
    for right in (False, True):
        s = T.sell(a, 2, right)
        assert {k: v for k, v in map(tuple, T.spmv_sell(s, x).collect())} == {k: v for k, v in want.items() if v}
    assert sorted(map(tuple, T.entries_of(T.csr(a)).collect())) == sorted(map(tuple, a.collect()))
    assert sorted(map(tuple, T.entries_of(T.csc(a)).collect())) == sorted(map(tuple, a.collect()))
    one = frame(spark, [[4]])
    assert X.scaled_symmetric(one).collect()[0].val == 1.0
    v = spark.createDataFrame([(0, 0.0), (1, -4.0), (2, 4.0)], "idx long, val double")
    assert [r.val for r in V.mapped(v, "inv").orderBy("idx").collect()] == [float("inf"), -0.25, 0.25]
    assert np.isnan(V.mapped(v, "sqrt").where("idx = 1").first().val)
    half = spark.createDataFrame([(0, 0.1), (1, 1e6)], "idx long, val double")
    assert [r.val for r in V.cast(half, "half").orderBy("idx").collect()] == [float(np.float16(0.1)), float("inf")]


def test_half_precision_is_numpys(spark):
    rng = np.random.default_rng(3)
    bits = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64)
    finite = bits[np.isfinite(bits)]
    v = np.concatenate([finite, (finite[:-1] + finite[1:]) / 2, rng.normal(size=2000) * 10.0 ** rng.integers(-9, 6, 2000), [np.inf, -np.inf, np.nan, 65519.9, 65520.0, 1e300, 5e-324]])
    df = spark.createDataFrame(list(enumerate(v.tolist())), "idx long, val double")
    got = np.array([r.val for r in V.cast(df, "half").orderBy("idx").collect()])
    with np.errstate(over="ignore"):
        assert np.array_equal(got, v.astype(np.float16).astype(np.float32), equal_nan=True)


def test_a_product_does_not_move_the_matrix(spark):
    """One exchange moves the vector to the matrix's buckets, one the partial sums."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        space = FrameSpace(Z.hpcg(spark, 6), spark.range(216).withColumnRenamed("id", "idx"))
        v = space.vector(Z.iota(spark, 216, 1))
        (x,) = space.settle(v)
        product = S.spmv(space.a, space.frame_of(x))
        plan = product._jdf.queryExecution().sparkPlan().toString(), product._jdf.queryExecution().executedPlan().toString()
        scan = plan[1][plan[1].index("Bucketed: true") - 2000 : plan[1].index("Bucketed: true")]
        joined = [line for line in plan[1].splitlines() if "Exchange" in line]
        assert len(joined) == 2 and "Exchange" not in scan[scan.rindex("Sort") :]
        before = {p for p in os.listdir(urlparse(shared_folder(spark)).path) if p.startswith("table-")}
        space.settle(x)
        after = {p for p in os.listdir(urlparse(shared_folder(spark)).path) if p.startswith("table-")}
        assert len(before - after) == len(after - before) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_gathered_vectors_step_in_one_job(spark):
    """A Richardson step of a space with vectors on the driver is one job, and gives what
    a FrameSpace gives; entries outside the domain do not count."""
    a = X.scaled_symmetric(Z.hpcg(spark, 5)).selectExpr("3 * row AS row", "3 * col AS col", "val")
    a = a.unionByName(spark.createDataFrame([(1, 0, 5.0), (0, 1, 7.0), (999, 0, 2.0)], "row long, col long, val double"))
    domain = spark.range(130).selectExpr("3 * id AS idx")
    b = domain.selectExpr("idx", "cast(idx + 1 AS double) AS val").where("idx <> 6")
    spaces = [sized_space(a, domain, 130), sized_space(a, domain, 129)]
    assert [type(s) for s in spaces] == [GatheredSpace, FrameSpace]
    found = []
    for s, steps in zip(spaces, (30, 2)):
        v = s.vector(b)
        spark.sparkContext.setJobGroup("steps", "steps")
        x = krylov.Richardson(s, None, steps, 0.42).solve(v, None, lambda k, norm: False)[0]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("steps"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs <= steps or s is spaces[1]
        x = krylov.Richardson(s, None, 2, 0.42).solve(v, None, lambda k, norm: False)[0] if s is spaces[0] else x
        found.append({r.idx: r.val for r in s.frame_of(x).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 130
    assert all(np.isclose(found[0][i], found[1][i], rtol=1e-12, atol=1e-12) for i in found[0])


def test_packed_rows(spark):
    """Long rows come in several runs, rows without entries are zero."""
    rng = np.random.default_rng(9)
    idx = np.sort(rng.choice(10_000, 300, replace=False))
    dense = rng.normal(size=(300, 300)) * (rng.random((300, 300)) < rng.random((300, 1)))
    dense[[0, 17]] = 0
    i, j = np.nonzero(dense)
    a = spark.createDataFrame(pa.table({"row": idx[i], "col": idx[j], "val": dense[i, j]}))
    x = rng.normal(size=300)
    for run in (1, 7, 512):
        assert np.allclose(S.Packed(a, idx, run)(x), dense @ x)


def test_three_decimals_of_large_values(spark):
    """1e-7 of the norm of b is more than half a unit of the third decimal here."""
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0)], "row long, col long, val double")
    b = spark.createDataFrame([(0, 40000.0), (1, 70000.0)], "idx long, val double")
    for space in (GatheredSpace, FrameSpace):
        got = Q._solved(spark, lambda s: krylov.Richardson(s, None, 80, 0.9), a, b, space=space, least=Q._THREE_DECIMALS)
        assert sorted(map(tuple, got.collect())) == [(0, 40000.0, True), (1, 70000.0, True)]


def test_records():
    m = MatrixMeta(10, 10, sets=((0, 0, 4), (1, 4, 10)))
    assert m.reversed().sets == ((0, 0, 6), (1, 6, 10)) and m.changed(pattern="colored").is_colored
    r = SolveResult(False, 3, 0.5)
    r += SolveResult(True, 2, 0.1)
    assert r == SolveResult(True, 5, 0.1)
    assert Z.grid_of("7_7_8") == (128, 128, 256)


# kernels


def random_rows(rng, n, density=0.3):
    dense = rng.normal(size=(n, n)) * (rng.random((n, n)) < density) + np.diag(5 + rng.random(n))
    return dense, K.rows_of(*np.nonzero(dense), dense[np.nonzero(dense)])


def dense_of(rows, n):
    out = np.zeros((n, n))
    i, j, v = K.entries(rows)
    out[i, j] = v
    return out


def test_factors_and_solves():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 20):
        dense, rows = random_rows(rng, n)
        for level in (0, 1, n):
            f = dense_of(K.ilu(rows, level), n)
            product = (np.tril(f, -1) + np.eye(n)) @ np.triu(f)
            assert np.allclose(product[dense != 0], dense[dense != 0])
        assert np.allclose(product, dense)  # with all fill the factorisation is exact
        b = rng.normal(size=n)
        x = K.solve_lower(rows, dict(enumerate(b)), unit=False)
        assert np.allclose(np.tril(dense) @ [x[i] for i in range(n)], b)
        x = K.solve_upper(rows, dict(enumerate(b)))
        assert np.allclose(np.triu(dense) @ [x[i] for i in range(n)], b)
        z, w, d = K.approximate_inverse(rows, 0.0, 1.0, True)
        inverse = dense_of(z, n).T @ np.diag([1 / d[i] for i in range(n)]) @ dense_of(w, n)
        assert np.allclose(inverse @ dense, np.eye(n), atol=1e-6)
    with pytest.raises(ValueError):
        K.ilu({0: {1: 1.0}, 1: {0: 1.0}})


def test_inverse_of_a_large_dense_block():
    """The sizes of the suppliers of sf0.1; entry by entry this takes hours if fill is
    followed, as every index has all others as neighbours."""
    rng = np.random.default_rng(3)
    dense = 0.003 + 0.002 * rng.random((700, 700)) + np.eye(700)
    i, j = np.nonzero(dense)
    began = time.perf_counter()
    nodes, z, w, d = K.whole_inverse(i, j, dense[i, j], follow_fill=True)
    assert time.perf_counter() - began < 20 and len(nodes) == 700
    assert np.allclose((z.T / d) @ w @ dense, np.eye(700), atol=1e-10)
    small, rows = dense[:70, :70], K.rows_of(*np.nonzero(np.ones((70, 70))), dense[:70, :70].ravel())
    began = time.perf_counter()
    assert all(len(x) == 70 for x in K.approximate_inverse(rows, 1e-9, 1.0, True))
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("follow", [False, True])
def test_whole_inverse_is_the_one_by_entries(follow):
    rng = np.random.default_rng(4)
    for t in range(60):
        n = int(rng.integers(1, 30))
        dense, rows = random_rows(rng, n, 0.15)
        if t % 3 == 0:
            dense = dense + dense.T
        if t % 4 == 0 and n > 3:
            dense[2, 2] = 0
        i, j = np.nonzero(dense)
        rows = K.rows_of((3 * i).tolist(), (3 * j).tolist(), dense[i, j].tolist())
        z, w, d = K.approximate_inverse(rows, 0.0, 1.5, follow)
        nodes, zs, ws, ds = K.whole_inverse(3 * i, 3 * j, dense[i, j], 1.5, follow, 4)
        assert nodes.tolist() == sorted(rows)
        for k, node in enumerate(nodes.tolist()):
            for one, many in ((z[node], zs[k]), (w[node], ws[k])):
                want = np.zeros(len(nodes))
                want[np.searchsorted(nodes, list(one))] = list(one.values())
                assert np.allclose(want, many, atol=1e-9 * max(1, abs(want).max()))
            assert np.isclose(d[node], ds[k])


def test_inverse_by_connected_parts(spark):
    """Parts of two blocks, interleaved, with a lone index: as each block by itself, and
    the same by entries (tol > 0) and dense (tol = 0)."""
    rng = np.random.default_rng(8)
    dense = np.zeros((24, 24))
    for part in ([0, 3, 5, 9], [1, 2, 11], [4, 6, 7, 8, 10], [12, 20, 23, 14], [13, 15, 16, 17, 18, 19, 21]):
        dense[np.ix_(part, part)] = rng.normal(size=(len(part), len(part))) * (rng.random((len(part), len(part))) < 0.8)
    dense += 6 * np.eye(24)
    i, j = np.nonzero(dense)
    a = X.block_diagonal(spark.createDataFrame(pa.table({"row": i, "col": j, "val": dense[i, j]})), 24, 2)
    parts = {r.idx: r.part for r in B.connected_parts(a, 5).collect()}
    for x in range(24):
        linked = {x}
        while (more := linked | {int(m) for k in linked for m in np.flatnonzero((dense[k] != 0) | (dense[:, k] != 0))}) != linked:
            linked = more
        assert parts.get(x, x) == min(linked)
    for tol in (0.0, 0.05):
        for follow in (False, True):
            got = {(r.factor, r.row, r.col): r.val for r in B.approximate_inverse(a, tol, 1.0, follow).collect()}
            want = {}
            for lo in (0, 12):
                r, c = np.nonzero(dense[lo : lo + 12, lo : lo + 12])
                z, w, d = K.approximate_inverse(K.rows_of((r + lo).tolist(), (c + lo).tolist(), dense[r + lo, c + lo].tolist()), tol, 1.0, follow)
                want |= {("z", k, n): v / d[n] for n in z for k, v in z[n].items()} | {("w", n, k): v for n in w for k, v in w[n].items()}
            assert all(np.isclose(got.get(k, 0.0), want.get(k, 0.0), atol=1e-12) for k in got.keys() | want.keys())


def test_inverse_with_missing_pairs_is_corrected(spark):
    """The inverse that does not follow fill is not exact here; its query's steps are."""
    rng = np.random.default_rng(2)
    dense = 0.02 * rng.random((60, 60)) * (rng.random((60, 60)) < 0.5)
    dense = dense + dense.T + np.eye(60)
    i, j = np.nonzero(dense)
    a = spark.createDataFrame(pa.table({"row": i, "col": j, "val": dense[i, j]}))
    m = precond.ApproximateInverse(a, 60, 1, 0.0)
    b = Z.iota(spark, 60, 1)
    once = {r.idx: r.val for r in S.spmv(a, m(b)).collect()}
    assert any(round(once[k], 4) != k + 1 for k in range(60))
    assert sorted(map(tuple, Q._by_inverse(spark, m, a, b).collect())) == [(k, k + 1.0) for k in range(60)]


def test_gram_by_connected_parts(spark):
    """Entries that repeat, nulls, columns outside the domain, indices without entries and
    pieces of a few products: every part's matrix is whole, and worked on once."""
    rng = np.random.default_rng(12)
    idx, rows, cols = np.sort(rng.choice(500, 40, replace=False)), [], []
    for k, own in enumerate(np.array_split(rng.permutation(37), [1, 3, 10, 22])):  # places 37, 38 and 39 have no entry
        for r in range(12):
            for c in rng.choice(own, min(len(own), 1 + r % 5)).tolist():
                rows.append(100 * k + r)
                cols.append(int(idx[c]))
    outside = next(x for x in range(500) if x not in idx)
    vals = rng.integers(-3, 9, len(rows)).astype(float)
    dense = np.zeros((1000, 40))
    np.add.at(dense, (rows, np.searchsorted(idx, cols)), vals)
    gram, n = dense.T @ dense, 40
    linked = np.linalg.matrix_power((abs(dense).T @ abs(dense) + np.eye(n) > 0).astype(float), 40) > 0
    entries = [*zip(rows, cols, vals.tolist()), (0, outside, 5.0), (1, outside, 5.0), (3, None, 2.0), (None, int(idx[0]), 4.0), (None, int(idx[5]), 4.0), (2, int(idx[38]), None)]
    b = spark.createDataFrame(entries, "row long, col long, val double")

    def work(at, row, col, val):
        assert (np.diff(at) > 0).all() and len(set(zip(row.tolist(), col.tolist()))) == len(row)
        return np.bincount(row, val * (at[col] + 1), len(at)) + 1e6 * len(at)

    for sizes in ({}, {"piece": 3, "fold": 4}):
        got = sorted(map(tuple, GP.per_gram_part(b, idx, work, **sizes).collect()))
        assert got == list(zip(idx.tolist(), (gram @ np.arange(1.0, 41) + 1e6 * linked.sum(1)).tolist()))
    none = b.where("row < 0")
    assert sorted(map(tuple, GP.per_gram_part(none, idx, work).collect())) == [(k, 1e6) for k in idx.tolist()]
    assert GP.per_gram_part(b, idx[:0], work).count() == 0


def test_parts_go_to_tasks_by_work():
    part = np.repeat([0, 5, 9, 12, 14], [5, 4, 3, 2, 1])
    share = GP._shares(part, 3)
    assert all(len(set(share[part == p])) == 1 for p in part) and set(share) == {0, 1, 2}
    assert len(set(GP._shares(np.repeat(np.arange(6) * 1000, 1000), 6))) == 6


def test_product_by_inverse_is_exact():
    rng = np.random.default_rng(2)
    dense = 0.02 * rng.random((60, 60)) * (rng.random((60, 60)) < 0.5)
    dense = (dense + dense.T + np.eye(60)) * 7
    i, j = np.nonzero(dense)
    b = np.arange(1.0, 61)
    for follow in (False, True):
        assert (precond.product_by_inverse(i, j, dense[i, j], b, 1e-7, 4e-5, follow).round(4) == b).all()
    nothing = np.zeros(0, int)
    assert (precond.product_by_inverse(nothing, nothing, np.zeros(0), np.zeros(2), 1e-7, 4e-5) == 0).all()
    with pytest.raises(ValueError, match="converge"):
        precond.product_by_inverse(nothing, nothing, np.zeros(0), np.ones(1), 1e-7, 4e-5)


def test_few_shuffle_partitions_do_not_enlarge_tasks(spark, monkeypatch):
    """Twelve parts under one shuffle partition: they were packed and inverted in one task."""
    monkeypatch.setattr(GP, "ENTRIES", 40)
    monkeypatch.setattr(GP, "CELLS", 9)
    monkeypatch.setattr(GP, "written", lambda df: packed.append(written(df)) or packed[-1])
    packed, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    b = spark.createDataFrame([(10 * k + r, 3 * k + c, 1.0) for k in range(12) for r in range(4) for c in range(3)], "row long, col long, val double")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = GP.per_gram_part(b, np.arange(36), lambda at, row, col, val: np.full(len(at), float(TaskContext.get().partitionId()))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tasks = {r.idx: r.val for r in found}
    assert len(tasks) == 36 and len(set(tasks.values())) == 12 and all(tasks[k] == tasks[k - k % 3] for k in range(36))
    rows = packed[0].where("starts is not null").select(F.input_file_name().alias("f")).distinct().count()
    assert rows > 1


def _linked_lines(spark):
    """Lines of parts of 40, 9 and 30 suppliers, with scattered indices, and B' B's own indices."""
    rng = np.random.default_rng(5)
    idx, entries = np.sort(rng.choice(400, 79, replace=False)), []
    for k, own in enumerate(np.split(rng.permutation(79), [40, 49])):
        for r in range(12 * len(own)):
            pair = [own[r % len(own)], own[(r + 1) % len(own)], own[rng.integers(len(own))]]
            entries += [(1000 * k + r, int(idx[p]), float(q)) for p, q in zip(pair, (20 + r % 9, 5, 3))]
    return spark.createDataFrame(entries, "row long, col long, val double"), idx


@pytest.mark.parametrize("follow", [False, True])
def test_parts_beyond_a_task_go_by_blocks(spark, follow):
    """A part that exceeds a task had no other way: it took its executor's memory."""
    lines, idx = _linked_lines(spark)
    parts = GP.GramParts(lines, idx)
    dense = np.zeros((4000, 79))
    for r, c, v in lines.collect():
        dense[r, np.searchsorted(idx, c)] += v
    x = np.arange(79.0) - 20
    assert np.allclose(parts.apply(x), dense.T @ (dense @ x)) and sorted(set(parts.sizes())) == [9, 30, 40]
    b, large = np.arange(1.0, 80), parts.sizes() > 10
    y = precond.products_by_blocks(parts, large, b, 1e-7, 4e-5, follow, block=8)
    assert (y.round(4) == b[large]).all()
    assert precond.products_by_blocks(parts, large, b, 1e-7, 4e-5, follow, block=8, cycles=0) is None


@pytest.mark.parametrize("name", ["blocks", "all blocks", "blocks fail"])
def test_parts_of_all_sizes_are_applied(spark, monkeypatch, name):
    lines, idx = _linked_lines(spark)
    if name == "blocks fail":
        monkeypatch.setattr(precond, "products_by_blocks", lambda *given: None)
    b = spark.createDataFrame([(int(i), k + 1.0) for k, i in enumerate(idx)], "idx long, val double")
    got = sorted(map(tuple, Q._by_inverse_of_parts(lines, b, False, 8 if name == "all blocks" else 10).collect()))
    assert got == [(int(i), k + 1.0) for k, i in enumerate(idx)]


@pytest.mark.parametrize("name", ["sdainv_apply", "ainv_apply"])
def test_inverse_is_applied_in_few_jobs(spark, name):
    """However many steps there are: a job a step and product took most of the time."""
    spark.sparkContext.setJobGroup(name, name)
    got = sorted(map(tuple, Q.queries()[name](spark, SF.replace("0.001", "0.01")).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [(k, k + 1.0) for k in range(100)] and jobs <= 16


def test_tiles_solve_like_rows():
    rng = np.random.default_rng(6)
    for n, lo, h, w in ((1, 0, 4, 2), (10, 0, 4, 2), (24, 8, 4, 4), (23, 0, 2, 8), (16, 0, 8, 1)):
        dense = np.zeros((64, 64))
        dense[lo : lo + n, lo : lo + n] = random_rows(rng, n)[0]
        b = rng.normal(size=n)
        for lower in (True, False):
            t = np.tril(dense) if lower else np.triu(dense)
            tiles = {(i, j): t[i * h : i * h + h, j * w : j * w + w] for i in range(64 // h) for j in range(64 // w) if t[i * h : i * h + h, j * w : j * w + w].any()}
            for unit in (True, False):
                full = t[lo : lo + n, lo : lo + n].copy()
                if unit:
                    np.fill_diagonal(full, 1.0)
                x = K.solve_tiles(tiles, dict(zip(range(lo, lo + n), b)), h, w, lower, unit)
                assert list(x) == list(range(lo, lo + n)) and np.allclose(full @ list(x.values()), b)


@pytest.mark.parametrize("kind", [np.float64, np.float32, np.float16])
def test_triangles_keep_their_precision(kind):
    rng = np.random.default_rng(7)
    dense, rows = random_rows(rng, 60)
    f = K.ilu(rows)
    i, j, v = (np.array(x) for x in K.entries(f))
    low, up = nested.Triangle(i[j <= i], j[j <= i], v[j <= i], 60, kind, True), nested.Triangle(i[j >= i], j[j >= i], v[j >= i], 60, kind, False)
    assert low.val.dtype == up.val.dtype == up.diagonal.dtype == low.solve(np.ones(60)).dtype == kind
    b = rng.normal(size=60)
    y = K.solve_lower(f, dict(enumerate(b)))
    x = K.solve_upper(f, y)
    want = np.array([x[k] for k in range(60)])
    got = up.solve(low.solve(b)).astype(np.float64)
    assert np.abs(got - want).max() <= 40 * np.finfo(kind).eps * np.abs(want).max()
    assert kind == np.float64 or np.abs(got - want).max() > 1e-12


def test_run_rows_and_histories(spark):
    a, b = Q._systems(spark)
    config = nested.Config(precision="half")
    runs = nested.run_systems(a, b, config, 3).collect()
    assert sorted((r.system, r.repetition) for r in runs) == [(s, k) for s in ("hpcg", "hpgmp") for k in range(3)]
    # a repetition begins anew: same number of calls, same residuals
    assert all(len({(r.iters, r.implicit, r.explicit) for r in runs if r.system == s}) == 1 for s in ("hpcg", "hpgmp"))
    assert all(r.solved and r.iters % 64 == 0 and r.implicit < 1e-8 and r.explicit < 2e-8 for r in runs)
    steps = nested.convergence(a, b, config).where("system = 'hpcg'").orderBy("step").collect()
    assert [r.step for r in steps] == list(range(len(steps))) and steps[0].relres == pytest.approx(1.0)
    assert (len(steps) - 1) * 64 == next(r.iters for r in runs if r.system == "hpcg")


def test_graph_kernels():
    rng = np.random.default_rng(2)
    for n in (1, 10, 60):
        src, dst = rng.integers(0, n, 3 * n), rng.integers(0, n, 3 * n)
        g = K.adjacency([*src, *dst], [*dst, *src], range(n))
        for kind in K.COLORINGS.values():
            c = kind(g)
            assert len(c) == n and min(c.values()) == 1 and all(c[a] != c[b] for a in g for b in g[a])
        blocks = K.connected_blocks(g, 7)
        sizes = np.bincount(list(blocks.values()))[1:]
        assert sizes.sum() == n and all(s == 7 for s in sizes[:-1])
        parts = K.with_separator(g, K.breadth_first_parts(g, 3), 3)
        assert not any(parts[a] != parts[b] and 3 not in (parts[a], parts[b]) for a in g for b in g[a])
        coarse = K.coarse_points(g)
        assert all(n in coarse or not g[n] or g[n] & coarse for n in g)


# solvers in numpy


def stencil(n, beta=0.0):
    at = np.array([(x, y, z) for z in range(n) for y in range(n) for x in range(n)])
    near = [(i, j) for i in range(n**3) for j in range(n**3) if np.abs(at[i] - at[j]).max() <= 1]
    row, col = np.array(near).T
    d = at[col] - at[row]
    face = (d[:, 0] == 0) & (d[:, 1] == 0)
    return row, col, np.where(row == col, 26.0, np.where(face & (d[:, 2] == -1), -1 - beta, np.where(face & (d[:, 2] == 1), -1 + beta, -1.0)))


@pytest.mark.parametrize("kind", [krylov.CG, krylov.CR, krylov.GCR, krylov.BiCGStab, krylov.FGMRES])
def test_solvers(kind):
    row, col, val = stencil(4)
    s = LocalSpace(row, col, val, 64)
    b = np.arange(64) + 1.0
    for m in (None, lambda v: v / 26):
        x, r = kind(s, m, 100).solve(b, None, krylov.relative(np.linalg.norm(b)))
        assert r.solved and np.linalg.norm(b - s.apply(x)) < 1e-7 * np.linalg.norm(b)
        again, r = kind(s, m, 100).solve(b, x, krylov.relative(np.linalg.norm(b), 1e-6))
        assert r.iters == 0 and (again == x).all()


@pytest.mark.parametrize("method,precision", [("f3r", "double"), ("f3r", "float"), ("f3r", "half"), ("static", "half"), *[(m, "half") for m in nested.DEPTHS], ("cg", "double"), ("bicgstab", "float"), ("gmres", "double")])
def test_nested(method, precision):
    row, col, val = stencil(5)
    scaled = nested.symmetric_scaling(row, col, val, 125)
    solver, calls = nested.pipeline(row, col, scaled, 125, nested.Config(method, precision))
    b = np.arange(125) + 1.0
    x, r = solver.solve(b, None, krylov.relative(np.linalg.norm(b)))
    left = b - np.bincount(row, scaled * x[col], 125)
    assert r.solved and np.linalg.norm(left) < 2e-8 * np.linalg.norm(b)
    if method == "f3r":
        assert r.iters <= 3 and calls == 64


def test_anything_with_operate_is_a_preconditioner():
    row, col, val = stencil(3)
    s = LocalSpace(row, col, val, 27)
    b = np.arange(27) + 1.0
    inner = krylov.CG(s, None, 2)
    x, r = krylov.FGMRES(s, inner, 30).solve(b, None, krylov.relative(np.linalg.norm(b)))
    y, q = krylov.FGMRES(s, inner.operate, 30).solve(b, None, krylov.relative(np.linalg.norm(b)))
    a = Coefficients(s)
    assert r.solved and r.iters == q.iters and (x == y).all() and np.linalg.norm(a.residual(b, x)) < 1e-7 * np.linalg.norm(b)
    assert np.allclose(a.operate(x), b, atol=1e-5)


def test_basis_first_gmres():
    row, col, val = stencil(4, 0.5)
    s = LocalSpace(row, col, nested.symmetric_scaling(row, col, val, 64), 64)
    b = np.arange(64) + 1.0
    for m in (None, lambda v: 0.9 * v):
        for steps in (1, 2, 5):
            x, r = krylov.BasisFirstGMRES(s, m, steps).solve(b)
            assert not r.solved and np.allclose(x, krylov.FGMRES(s, m, steps).solve(b)[0], atol=1e-6)
    x, _ = krylov.BasisFirstGMRES(LocalSpace(np.arange(3), np.arange(3), np.ones(3), 3), None, 5).solve(np.ones(3))
    assert np.allclose(x, 1)


def test_pluggable_multigrid(spark):
    seen = []

    def pack(k):
        return lambda a: seen.append(k) or precond.smoother(a, precond.spai0(a), 1)

    a = Z.hpcg(spark, 5)
    m = amg.AMG(a, spark.range(125).withColumnRenamed("id", "idx"), coarsest=lambda level, n: n <= 4, smoothers=[pack(0), pack(1)], coarsen=amg.coarse_points_parallel)
    assert seen == [k % 2 for k in range(len(m.levels))] and len(seen) >= 2 and len(m.idx) <= 4


def test_richardson_and_restarts():
    row, col, val = stencil(3)
    s = LocalSpace(row, col, nested.symmetric_scaling(row, col, val, 27), 27)
    b = np.ones(27)
    done = krylov.relative(np.linalg.norm(b))
    for solver in (krylov.Richardson(s, None, 200, 0.7), krylov.Restarted(krylov.AdaptiveRichardson(s, None, 4, 1), 60), krylov.Restarted(krylov.FGMRES(s, None, 3), 30)):
        x, r = solver.solve(b, None, done)
        assert r.solved and np.linalg.norm(b - s.apply(x)) < 1e-7
    smooth = krylov.Richardson(s, None, 2, 0.7)
    assert np.linalg.norm(b - s.apply(smooth.operate(b))) < np.linalg.norm(b)
