"""Sparse matrix algebra on (col, row, val) DataFrames, unique on (col, row); an absent entry is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

KEYS = ("col", "row")


def positive(abc: DataFrame) -> DataFrame:
    """Entries with a value above zero; the rest counts as absent."""
    return abc.select("col", "row", "val").where("val > 0")


def dedup(abc: DataFrame, policy: str = "max", seq: str | None = None) -> DataFrame:
    """One value for each place: the largest, or with policy 'first' that of the smallest ``seq``."""
    value = {"max": F.max("val"), "first": F.min_by("val", seq) if seq else None}[policy]
    if value is None:
        raise ValueError("policy 'first' needs a column that orders the entries")
    return abc.groupBy(*KEYS).agg(value.alias("val"))


def add_loops(m: DataFrame, missing_diagonal: str = "error") -> DataFrame:
    """The diagonal of every column that has entries becomes its largest other value, 1 if there is none.

    A column without a diagonal entry is an error, or gets one with ``missing_diagonal='insert'``.
    """
    off = F.max(F.when(F.col("row") != F.col("col"), F.col("val")))
    has = F.max((F.col("row") == F.col("col")).cast("int"))
    if missing_diagonal == "insert":
        loops = m.groupBy("col").agg(F.coalesce(off, F.lit(1.0)).alias("val")).select("col", F.col("col").alias("row"), "val")
        return m.where("row <> col").select("col", "row", "val").unionByName(loops)
    if missing_diagonal != "error":
        raise ValueError(missing_diagonal)
    by = Window.partitionBy("col")
    checked = m.select("col", "row", "val", off.over(by).alias("off"), has.over(by).alias("has"))
    lost = F.raise_error(F.concat(F.lit("no diagonal entry in column "), F.col("col"))).cast("double")
    value = F.when(F.col("has") == 0, lost).when(F.col("row") == F.col("col"), F.coalesce("off", F.lit(1.0))).otherwise(F.col("val"))
    return checked.select("col", "row", value.alias("val"))


def normalise(m: DataFrame) -> DataFrame:
    """Columns that sum to one."""
    return m.select("col", "row", (F.col("val") / F.sum("val").over(Window.partitionBy("col"))).alias("val"))


def replicate_diagonal(m: DataFrame, n: int, scale: int) -> DataFrame:
    """``scale`` copies of an n x n matrix as blocks along the diagonal."""
    if scale < 1:
        raise ValueError("scale must be at least 1")
    copies = m.select("col", "row", "val", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(scale - 1).cast("long"))).alias("i"))
    return copies.select((F.col("col") + F.col("i") * n).alias("col"), (F.col("row") + F.col("i") * n).alias("row"), "val")


def _counted(pairs: DataFrame, count: Observation | None) -> DataFrame:
    return pairs.observe(count, F.count("*").alias("products")) if count else pairs


def expansion_size(m: DataFrame, a: DataFrame) -> int:
    """Products that ``multiply`` sums up: over every inner index, entries of its column times entries of its row."""
    left = m.groupBy(F.col("col").alias("k")).agg(F.count("*").alias("x"))
    right = a.groupBy(F.col("row").alias("k")).agg(F.count("*").alias("y"))
    return left.join(right, "k").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def multiply(m: DataFrame, a: DataFrame, strategy: str = "coo", count: Observation | None = None) -> DataFrame:
    """The product m x a; ``count`` gets ``products``, how many values are summed up.

    'coo' is a join on the inner index and a sum that is combined before the shuffle. 'blocked' sends the entries of an inner
    index to one place as arrays, and expands them there: fewer rows pass the join where columns are long.
    """
    if strategy == "coo":
        left, right = m.select(F.col("col").alias("k"), "row", F.col("val").alias("x")), a.select(F.col("row").alias("k"), "col", F.col("val").alias("y"))
        pairs = _counted(left.join(right, "k"), count)
        return pairs.groupBy("col", "row").agg(F.sum(F.col("x") * F.col("y")).alias("val"))
    if strategy != "blocked":
        raise ValueError(strategy)
    left = m.groupBy(F.col("col").alias("k")).agg(F.collect_list(F.struct("row", F.col("val").alias("x"))).alias("l"))
    right = a.groupBy(F.col("row").alias("k")).agg(F.collect_list(F.struct("col", F.col("val").alias("y"))).alias("r"))
    pairs = _counted(left.join(right, "k").select("l", F.explode("r").alias("r")).select("r", F.explode("l").alias("l")), count)
    return pairs.groupBy(F.col("r.col").alias("col"), F.col("l.row").alias("row")).agg(F.sum(F.col("l.x") * F.col("r.y")).alias("val"))


def add(*parts: DataFrame) -> DataFrame:
    """The sum of matrices."""
    out = parts[0].select("col", "row", "val")
    for p in parts[1:]:
        out = out.unionByName(p.select("col", "row", "val"))
    return out.groupBy(*KEYS).agg(F.sum("val").alias("val"))


def squared_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ssd: the sum of squared differences over all places.

    The two sides are stacked and summed, which takes one combined shuffle instead of a full outer join of two.
    """
    both = a.select("col", "row", "val").unionByName(b.select("col", "row", (-F.col("val")).alias("val")))
    each = both.groupBy(*KEYS).agg(F.sum("val").alias("d"))
    return each.agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("ssd"))


def ssd(a: DataFrame, b: DataFrame) -> float:
    return squared_differences(a, b).first()[0]


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two matrices have the same entries, bit by bit."""
    a, b = a.select("col", "row", "val"), b.select("col", "row", "val")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def block_of(index: str | Column, nsub: int) -> Column:
    return F.floor((F.col(index) if isinstance(index, str) else index) / nsub).cast("long")


def transpose_blocks(m: DataFrame, nsub: int) -> DataFrame:
    """Entries of every nsub x nsub block that has any: block (of rows), slice (of columns), size."""
    return m.groupBy(block_of("row", nsub).alias("block"), block_of("col", nsub).alias("slice")).agg(F.count("*").alias("size"))


def by_row(m: DataFrame, nsub: int) -> DataFrame:
    """The entries of each row-slice together, with block-local rows: what the right side of a product needs."""
    return m.select(block_of("row", nsub).alias("block"), block_of("col", nsub).alias("slice"), "col", (F.col("row") % nsub).alias("local_row"), "val").repartition("block")


def dense(m: DataFrame, n: int) -> DataFrame:
    """All n values of each column as an array, for printing small matrices."""
    by = m.groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("row", "val"))).alias("v"))
    values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("v", i.cast("long")), F.lit(0.0)))
    return by.select("col", values.alias("vals"))


def analyse(abc: DataFrame) -> DataFrame:
    """One row n, kmax, nnz of the positive entries: largest index + 1, most entries of a column (repeats included), entries."""
    columns = positive(abc).groupBy("col").agg(F.max("row").alias("r"), F.count("*").alias("k"))
    return columns.agg(F.coalesce(F.max(F.greatest("col", "r")) + 1, F.lit(0)).alias("n"), F.coalesce(F.max("k"), F.lit(0)).alias("kmax"), F.coalesce(F.sum("k"), F.lit(0)).alias("nnz"))


def build(abc: DataFrame, missing_diagonal: str = "error", policy: str = "max", seq: str | None = None) -> DataFrame:
    """A column-stochastic matrix: positive entries, one value a place, loops, columns normalised."""
    kept = abc.where("val > 0") if seq else positive(abc)
    return normalise(add_loops(dedup(kept, policy, seq), missing_diagonal))
