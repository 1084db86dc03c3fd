"""Schemas, parameters with their defaults, and records of the engine."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import types as T

ABC = T.StructType([T.StructField("col", T.LongType()), T.StructField("row", T.LongType()), T.StructField("val", T.DoubleType())])
CLUSTERS = T.StructType([T.StructField("node", T.LongType()), T.StructField("cluster", T.LongType())])

#: Auto-prune: threshold = A * mean * (1 - B * (max - mean)), at least FLOOR.
AUTO_A, AUTO_B, AUTO_FLOOR = 0.9, 2.0, 1e-7
#: Values are compared with the cutoff and ranked after rounding to so many digits, so that ties don't depend on the order of a sum.
TIE_DIGITS = 12


@dataclass(frozen=True)
class Params:
    """Parameters of a flow clustering run."""

    inflation: float = 2.0
    cutoff: float = 1e-4
    select: int = 50
    auto_prune: bool = False
    balance: float = 1.0
    max_iter: int = 10_000
    min_iter: int = 10
    chaos_limit: float = 1e-4
    change_limit: float = 1e-4
    force_iter: int = 0
    float32: bool = False

    def __post_init__(self):
        if self.select < 1 or self.inflation <= 0 or self.cutoff < 0:
            raise ValueError(f"select >= 1, inflation > 0 and cutoff >= 0 are needed: {self}")

    @staticmethod
    def prune(inverse_cutoff: float | None = None, **options) -> Params:
        """Parameters with the cutoff given as 1/x; an explicit cutoff wins."""
        if inverse_cutoff and "cutoff" not in options:
            options["cutoff"] = 1 / inverse_cutoff
        return Params(**options)


@dataclass(frozen=True)
class MatrixMeta:
    """What is known of a stored matrix beside its entries."""

    n: int
    nsub: int = 128
    kmax: int = 0
    te: int = 1
    varints: bool = False

    def check(self, other: MatrixMeta | None = None) -> MatrixMeta:
        if self.n <= 0 or self.nsub <= 0 or self.te <= 0 or self.kmax < 0:
            raise ValueError(f"n, nsub and te must be positive and kmax not negative: {self}")
        if other and (self.n, self.nsub, self.varints) != (other.n, other.nsub, other.varints):
            raise ValueError(f"matrices differ in n, nsub or varints: {self}, {other}")
        return self

    def product(self, other: MatrixMeta) -> MatrixMeta:
        """Metadata of a product: a column has at most kmax * kmax entries."""
        self.check(other)
        return MatrixMeta(self.n, self.nsub, min(self.n, self.kmax * other.kmax), self.te, self.varints)


@dataclass
class StepStats:
    """What one iteration did; change is infinite where two iterates weren't compared."""

    iter: int = 0
    chaos: float = 0.0
    change: float = float("inf")
    kmax: int = 0
    in_nnz: int = 0
    out_nnz: int = 0
    cutoff: int = 0
    prune: int = 0
    attractors: int = 0
    homogen: int = 0
    seconds: float = 0.0
    init_nnz: int = 0
    products: int = 0

    @property
    def expa(self) -> float:
        """Size of the expansion against the input."""
        return (self.out_nnz + self.cutoff + self.prune) / (self.in_nnz + 1)

    @property
    def expb(self) -> float:
        return self.out_nnz / (self.in_nnz + 1)

    @property
    def expc(self) -> float:
        return self.out_nnz / (self.init_nnz + 1)

    COUNTERS = ("kmax", "in_nnz", "products", "out_nnz", "cutoff", "prune", "attractors", "homogen")

    def counters(self) -> list[tuple[int, str, str, str, int]]:
        """Rows of the counters file."""
        return [(self.iter, "step", "matrix", k, int(getattr(self, k))) for k in self.COUNTERS]


def as_row(record) -> dict:
    return asdict(record)


def names(record) -> list[str]:
    return [f.name for f in fields(record)]
