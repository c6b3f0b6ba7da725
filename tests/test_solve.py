"""The command line."""

import pytest

from spandrel.solve import parsed, solved
from spandrel.sources import matrix_market as M
from spandrel.sources import stencils as Z
from spandrel.meta import MatrixMeta


def test_arguments(capsys):
    path, n, c = parsed(["a.mtx", "1.1", "3", "8", "4", "2", "64", "5", "--precision", "half"])
    assert (path, n, c.method, c.acc, c.m2, c.m3, c.m4, c.period, c.restart, c.precision) == ("a.mtx", 3, "f3r", 1.1, 8, 4, 2, 64, 5, "half")
    assert parsed(["a.mtx", "1", "1", "8", "4", "2", "64", "3", "0.9"])[2].method == "static"
    assert parsed(["a.mtx", "1", "1", "--method", "gmres"])[2].method == "gmres"
    with pytest.raises(SystemExit):
        parsed(["a.mtx", "1", "1", "8"])


def test_solved(spark, tmp_path):
    path = str(tmp_path / "hpcg_2.mtx")
    M.write_matrix(Z.hpcg(spark, 4), MatrixMeta(64, 64), path)
    for arguments in (["8", "4", "2", "64", "3"], ["--method", "bicgstab"]):
        (row,) = solved(spark, *parsed([path, "1.0", "2", *arguments])).collect()
        assert row.Problem == "hpcg_2" and row.Time > 0 and row.Iter > 0 and row.ImplRes < 1e-8 and row.ExplRes < 2e-8
