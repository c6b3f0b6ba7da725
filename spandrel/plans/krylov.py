"""Krylov solvers over any space of spaces.py.

solve(b, x) starts from x (zero if None), keeps a guess that already passes, and
returns x and a SolveResult; done(iteration, norm of the residual) is the stop
test.  operate(v) runs the same recurrence from zero without a test, so that a
solver can precondition another one.  m is a function of vectors, or anything with
operate (the identity if None).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..meta import SolveResult

Done = Callable[[int, float], bool]


def relative(norm_b: float, tol: float = 1e-8) -> Done:
    """Stop when the residual is below tol times the norm of the right-hand side."""
    return lambda _, norm: norm < tol * norm_b


def _never(_: int, __: float) -> bool:
    return False


@dataclass
class Solver:
    """What all solvers share: the space, the preconditioner, the iteration limit."""

    space: object
    m: Callable | None = None
    max_iter: int = 100
    history: list[tuple[int, float]] = field(default_factory=list)

    def __post_init__(self):
        self.m = getattr(self.m, "operate", self.m)

    def precondition(self, v):
        return v if self.m is None else self.m(v)

    def start(self, b, x):
        """First guess, its residual and the residual's norm."""
        s = self.space
        if x is None:
            x, r = s.zeros(), b
        else:
            r = b - s.apply(x)
        return x, r, math.sqrt(s.dots((r, r))[0])

    def noted(self, done: Done, k: int, norm: float) -> bool:
        self.history.append((k, norm))
        return done(k, norm)

    def solve(self, b, x=None, done: Done = _never):
        x, r, norm = self.start(b, x)
        if self.noted(done, 0, norm):
            return x, SolveResult(True, 0, norm)
        return self.iterate(x, r, norm, done)

    def operate(self, v):
        return self.solve(v)[0]

    def iterate(self, x, r, norm: float, done: Done):
        raise NotImplementedError


class CG(Solver):
    """Conjugate gradients."""

    def iterate(self, x, r, norm, done):
        s = self.space
        z = self.precondition(r)
        p = z
        rz = s.dots((r, z))[0]
        for k in range(1, self.max_iter + 1):
            q = s.apply(p)
            pq = s.dots((p, q))[0]
            if pq == 0:
                return x, SolveResult(False, k - 1, norm)
            x, r, p = s.settle(x + (rz / pq) * p, r - (rz / pq) * q, p)
            z = self.precondition(r)
            new, rr = s.dots((r, z), (r, r))
            norm = math.sqrt(rr)
            if self.noted(done, k, norm):
                return x, SolveResult(True, k, norm)
            p, rz = z + (new / rz) * p, new
        return x, SolveResult(False, self.max_iter, norm)


class CR(Solver):
    """Conjugate residuals, on the preconditioned residual."""

    def iterate(self, x, r, norm, done):
        s = self.space
        z = self.precondition(r)
        p, az = z, s.apply(z)
        q = az
        za = s.dots((z, az))[0]
        for k in range(1, self.max_iter + 1):
            mq = self.precondition(q)
            qq = s.dots((mq, q))[0]
            if qq == 0 or za == 0:
                return x, SolveResult(False, k - 1, norm)
            alpha = za / qq
            x, r, z, p, q = s.settle(x + alpha * p, r - alpha * q, z - alpha * mq, p, q)
            norm = math.sqrt(s.dots((r, r))[0])
            if self.noted(done, k, norm):
                return x, SolveResult(True, k, norm)
            az = s.apply(z)
            new = s.dots((z, az))[0]
            p, q, za = z + (new / za) * p, az + (new / za) * q, new
        return x, SolveResult(False, self.max_iter, norm)


class GCR(Solver):
    """Generalised conjugate residuals with full orthogonalisation."""

    def iterate(self, x, r, norm, done):
        s = self.space
        us, cs, sizes = [], [], []
        for k in range(1, self.max_iter + 1):
            u = self.precondition(r)
            c = s.apply(u)
            if cs:
                for f, size, v, w in zip(s.dots(*[(c, w) for w in cs]), sizes, us, cs):
                    u, c = u - (f / size) * v, c - (f / size) * w
            size, rc = s.dots((c, c), (r, c))
            if size == 0:
                return x, SolveResult(False, k - 1, norm)
            x, r = x + (rc / size) * u, r - (rc / size) * c
            kept = s.settle(x, r, u, c, *us, *cs)
            x, r, u, c = kept[:4]
            us, cs = [*kept[4 : 4 + len(us)], u], [*kept[4 + len(us) :], c]
            sizes.append(size)
            norm = math.sqrt(s.dots((r, r))[0])
            if self.noted(done, k, norm):
                return x, SolveResult(True, k, norm)
        return x, SolveResult(False, self.max_iter, norm)


class BiCGStab(Solver):
    """Stabilised biconjugate gradients; two preconditioner calls a step."""

    def iterate(self, x, r, norm, done):
        s = self.space
        shadow, p = r, r
        rho = s.dots((shadow, r))[0]
        for k in range(1, self.max_iter + 1):
            y = self.precondition(p)
            v = s.apply(y)
            sv = s.dots((shadow, v))[0]
            if sv == 0 or rho == 0:
                return x, SolveResult(False, k - 1, norm)
            alpha = rho / sv
            half = r - alpha * v
            z = self.precondition(half)
            t = s.apply(z)
            ts, tt = s.dots((t, half), (t, t))
            omega = ts / tt if tt else 0.0
            x, r, p, v, shadow = s.settle(x + alpha * y + omega * z, half - omega * t, p, v, shadow)
            rr, new = s.dots((r, r), (shadow, r))
            norm = math.sqrt(rr)
            if self.noted(done, k, norm):
                return x, SolveResult(True, k, norm)
            if omega == 0:
                return x, SolveResult(False, k, norm)
            p = r + (new / rho * alpha / omega) * (p - omega * v)
            rho = new
        return x, SolveResult(False, self.max_iter, norm)


class FGMRES(Solver):
    """Flexible GMRES: classical Gram-Schmidt, a QR of the small Hessenberg matrix on
    the driver, and the preconditioned directions kept."""

    def iterate(self, x, r, norm, done):
        s = self.space
        if norm == 0:
            return x, SolveResult(done is not _never, 0, 0.0)
        basis, directions = [(1.0 / norm) * r], []
        h = np.zeros((self.max_iter + 1, self.max_iter))
        solved, k = False, 0
        for k in range(1, self.max_iter + 1):
            z = self.precondition(basis[-1])
            w = s.apply(z)
            kept = s.settle(w, z, x, *basis, *directions)
            w, z, x = kept[:3]
            basis, directions = kept[3 : 3 + k], [*kept[3 + k :], z]
            found = s.dots(*[(v, w) for v in basis])
            for i, f in enumerate(found):
                h[i, k - 1] = f
                w = w - f * basis[i]
            h[k, k - 1] = size = math.sqrt(max(0.0, s.dots((w, w))[0]))
            y, left = self._least_squares(h[: k + 1, :k], norm)
            solved = self.noted(done, k, left)
            if solved or size <= 1e-300:
                break
            if k < self.max_iter:
                basis.append((1.0 / size) * w)
        for f, z in zip(y, directions):
            x = x + float(f) * z
        return s.settle(x)[0], SolveResult(solved, k, left)

    @staticmethod
    def _least_squares(h: np.ndarray, norm: float) -> tuple[np.ndarray, float]:
        """Coefficients that leave the smallest residual, by plane rotations."""
        r, g = h.copy(), np.zeros(len(h))
        g[0] = norm
        k = h.shape[1]
        for j in range(k):
            a, b = r[j, j], r[j + 1, j]
            size = math.hypot(a, b)
            if size:
                turn = np.array([[a, b], [-b, a]]) / size
                r[j : j + 2] = turn @ r[j : j + 2]
                g[j : j + 2] = turn @ g[j : j + 2]
        y = np.zeros(k)
        for j in range(k - 1, -1, -1):
            y[j] = (g[j] - r[j, j + 1 : k] @ y[j + 1 :]) / r[j, j] if r[j, j] else 0.0
        return y, abs(float(g[k]))


class BasisFirstGMRES(FGMRES):
    """GMRES over the powers of A M on the residual, all made before they are made
    orthogonal (by modified Gram-Schmidt, with the triangle kept): max_iter products
    in a row, one update, and no test in between, so it never reports convergence."""

    def iterate(self, x, r, norm, done):
        s = self.space
        if norm == 0:
            return x, SolveResult(False, 0, 0.0)
        powers, directions, sizes = [(1.0 / norm) * r], [], []
        for _ in range(self.max_iter):
            z = self.precondition(powers[-1])
            w = s.apply(z)
            size = math.sqrt(s.dots((w, w))[0])
            if size <= 1e-300:
                break
            directions.append(z)
            sizes.append(size)
            powers.append((1.0 / size) * w)
            kept = s.settle(x, *powers, *directions)
            x, powers, directions = kept[0], kept[1 : 1 + len(powers)], kept[1 + len(powers) :]
        k = len(directions)
        # powers = basis times triangle
        basis, triangle = [], np.zeros((k + 1, k + 1))
        for j in range(k + 1):
            v = powers.pop(0)
            for i, q in enumerate(basis):
                triangle[i, j] = s.dots((q, v))[0]
                v = v - float(triangle[i, j]) * q
            triangle[j, j] = size = math.sqrt(s.dots((v, v))[0])
            if size <= 1e-14:
                k = j
                break
            kept = s.settle(x, *basis, (1.0 / size) * v, *powers, *directions)
            x, basis, powers, directions = kept[0], kept[1 : j + 2], kept[j + 2 : j + 2 + len(powers)], kept[j + 2 + len(powers) :]
        # A M powers[j] = sizes[j] * powers[j + 1]: the Hessenberg matrix of the directions
        g = np.zeros(len(triangle))
        g[0] = norm
        y = np.linalg.lstsq(triangle[:, 1 : k + 1] * np.array(sizes[:k]), g, rcond=None)[0] if k else []
        for f, z in zip(y, directions):
            x = x + float(f) * z
        return s.settle(x)[0], SolveResult(False, k, norm)


class Richardson(Solver):
    """x += omega M r, max_iter times; solve() tests before each update."""

    def __init__(self, space, m=None, max_iter: int = 2, omega: float = 1.0):
        super().__init__(space, m, max_iter)
        self.omega = omega

    def iterate(self, x, r, norm, done):
        s, b = self.space, None
        for k in range(1, self.max_iter + 1):
            d = self.precondition(r)
            x = x + self.omega * d
            if done is _never and k == self.max_iter:
                return s.settle(x)[0], SolveResult(False, k, norm)
            x, r = s.settle(x, r - self.omega * s.apply(d))
            norm = math.sqrt(s.dots((r, r))[0])
            if self.noted(done, k, norm):
                return x, SolveResult(True, k, norm)
        return x, SolveResult(False, self.max_iter, norm)

    def smooth(self, b, x):
        """max_iter steps from x without a test."""
        return self.solve(b, x)[0]


class AdaptiveRichardson(Richardson):
    """Richardson whose weights, one for each inner step, are refitted in every
    ``period``-th call: the refitted weight (A M r, r) / (A M r, A M r) is used at
    once and averaged into the one used in other calls.  The average begins with 1."""

    def __init__(self, space, m=None, max_iter: int = 2, period: int = 64):
        super().__init__(space, m, max_iter)
        self.period = period
        self.reset()

    def reset(self) -> None:
        self.calls = 0
        self.weights, self.sums, self.fits = [1.0] * self.max_iter, [1.0] * self.max_iter, 1

    def iterate(self, x, r, norm, done):
        s = self.space
        self.calls += 1
        refit = self.calls % self.period == 0
        self.fits += refit
        for k in range(self.max_iter):
            d = self.precondition(r)
            last = k == self.max_iter - 1 and done is _never
            ad = None if last and not refit else s.apply(d)
            omega = self.weights[k]
            if refit:
                top, bottom = s.dots((ad, r), (ad, ad))
                omega = top / bottom if bottom else omega
                self.sums[k] += omega
                self.weights[k] = self.sums[k] / self.fits
            x = x + omega * d
            if last:
                break
            x, r = s.settle(x, r - omega * ad)
            if done is not _never:
                norm = math.sqrt(s.dots((r, r))[0])
                if self.noted(done, k + 1, norm):
                    return x, SolveResult(True, k + 1, norm)
        return s.settle(x)[0], SolveResult(False, self.max_iter, norm)


class Restarted:
    """Repeats an inner solve from where it ended, max_iter cycles at most."""

    def __init__(self, inner: Solver, max_iter: int = 10):
        self.inner, self.max_iter = inner, max_iter

    def solve(self, b, x=None, done: Done = _never):
        total = SolveResult()
        for _ in range(self.max_iter):
            x, one = self.inner.solve(b, x, done)
            total += one
            if one.solved:
                break
        return x, total

    def operate(self, v):
        return self.solve(v)[0]


def cocg(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, done: Done, max_iter: int = 100) -> tuple[np.ndarray, SolveResult]:
    """CG with unconjugated products, for complex symmetric systems in one task."""
    x, r = np.zeros_like(b), b.copy()
    p, rr, norm = r, r @ r, float(np.linalg.norm(b))
    for k in range(1, max_iter + 1):
        q = apply(p)
        alpha = rr / (p @ q)
        x, r = x + alpha * p, r - alpha * q
        norm = float(np.linalg.norm(r))
        if done(k, norm):
            return x, SolveResult(True, k, norm)
        new = r @ r
        p, rr = r + (new / rr) * p, new
    return x, SolveResult(False, max_iter, norm)
