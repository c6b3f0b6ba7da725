"""Schemas and small records that describe matrices and solver results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

MATRIX = "row long, col long, val double"
VECTOR = "idx long, val double"
EDGES = "src long, dst long"
PERMUTATION = "new long, old long"

FORMS = ("square", "lower", "lower_d", "d_upper", "upper")
PATTERNS = ("general", "diagonal", "block_diagonal", "colored", "colored2", "partitioned")


@dataclass(frozen=True)
class MatrixMeta:
    """Attributes of a matrix frame: shape, value type, symmetry, form, pattern, and
    the bounds (set_id, lo, hi) of its blocks or colours where it has any."""

    nrows: int
    ncols: int
    kind: str = "real"
    symmetry: str = "general"
    form: str = "square"
    pattern: str = "general"
    sets: tuple[tuple[int, int, int], ...] = field(default=())

    def changed(self, **what) -> MatrixMeta:
        return replace(self, **what)

    def reversed(self) -> MatrixMeta:
        """Bounds of the sets after a rotation by 180 degrees."""
        n, m = self.nrows, len(self.sets)
        return replace(self, sets=tuple((m - 1 - s, n - hi, n - lo) for s, lo, hi in reversed(self.sets)))

    @property
    def is_symmetric(self) -> bool:
        return self.symmetry == "symmetric"

    @property
    def is_colored(self) -> bool:
        return self.pattern in ("colored", "colored2")


@dataclass
class SolveResult:
    """Outcome of a solve; sums of outcomes are those of repeated cycles."""

    solved: bool = False
    iters: int = 0
    res: float = float("inf")

    def __iadd__(self, other: SolveResult) -> SolveResult:
        self.solved |= other.solved
        self.iters += other.iters
        self.res = other.res
        return self
