"""Weighted pixel graphs: neighbours within a radius, by equi-joins on shifted coordinates."""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphflow.scratch import Scratch

#: Vectors of a block that looks for its neighbours, and of one that it meets; bytes of the latter that are broadcast at once.
ASKED, TILE, BROADCAST_BYTES = 512, 4096, 64_000_000
#: Digits of a stored weight.
DIGITS = 6
#: Fixed value: range of the intensity of a time-of-flight frame.
INTENSITY = 65535.0
#: Spread of the older image weight: a neighbour at distance 3 weighs one half.
OLD_SIGMA = math.sqrt(-9 / math.log(0.5))


def offsets_within(radius: float) -> list[tuple[int, int]]:
    """All whole (dx, dy) with dx^2 + dy^2 <= radius^2, the origin included."""
    r = int(math.floor(radius))
    return [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if x * x + y * y <= radius * radius]


def n_offsets(radius: float) -> int:
    return len(offsets_within(radius))


def offsets(spark: SparkSession, radius: float) -> DataFrame:
    """dx, dy of the closed disc, made by the engine."""
    r = int(math.floor(radius))
    line = F.sequence(F.lit(-r), F.lit(r))
    both = spark.range(1).select(F.explode(line).alias("dx")).select("dx", F.explode(line).alias("dy"))
    return both.where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius)


def local_offsets(x: int, y: int, w: int, h: int, radius: float) -> list[tuple[int, int]]:
    """Offsets that stay within a w x h image from (x, y)."""
    return [(dx, dy) for dx, dy in offsets_within(radius) if 0 <= x + dx < w and 0 <= y + dy < h]


def node_of(x: Column, y: Column, w: int | Column, h: int | Column, order: str = "column") -> Column:
    """Number of a pixel, column by column (y + h * x) or row by row (x + w * y)."""
    if order not in ("column", "row"):
        raise ValueError(order)
    return (y + h * x if order == "column" else x + w * y).cast("long")


def neighbours(pixels: DataFrame, radius: float) -> DataFrame:
    """Every pixel with each pixel of the image within the radius, itself included: x, y, dx, dy and both values as structs p, q.

    Each pixel is repeated for its offsets, at most a few dozen, and meets its neighbour by equality of coordinates.
    """
    rest = [c for c in pixels.columns if c not in ("x", "y")]
    near = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in offsets_within(radius)))
    here = pixels.select("x", "y", F.struct(*rest).alias("p"), F.explode(near).alias("o"))
    here = here.select("x", "y", "p", "o.dx", "o.dy", (F.col("x") + F.col("o.dx")).alias("x2"), (F.col("y") + F.col("o.dy")).alias("y2"))
    there = pixels.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.struct(*rest).alias("q"))
    return here.join(there, ["x2", "y2"])


def _distance(bands, p: str = "p", q: str = "q") -> Column:
    parts = [(F.col(f"{p}.{b}") - F.col(f"{q}.{b}")) * (F.col(f"{p}.{b}") - F.col(f"{q}.{b}")) for b in bands]
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def _graph(pairs: DataFrame, weight: Column, w, h, order: str) -> DataFrame:
    return pairs.select(
        node_of(F.col("x"), F.col("y"), w, h, order).alias("col"), node_of(F.col("x2"), F.col("y2"), w, h, order).alias("row"), F.round(weight, DIGITS).alias("val")
    )


def image_similarity(pixels: DataFrame, w: int, h: int, radius: float = 3.0, sigma_x: float = 1.0, sigma_f: float = 1.0, bands=("c0", "c1", "c2"), order: str = "column") -> DataFrame:
    """col, row, val of all neighbouring pixels: exp(-distance^2 / sigma_x - colour distance^2 / sigma_f), rounded to six digits."""
    pairs = neighbours(pixels.select("x", "y", *bands), radius)
    place = (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.lit(float(sigma_x))
    return _graph(pairs, F.exp(-place - _distance(bands) / F.lit(float(sigma_f))), w, h, order)


def image_similarity_old(pixels: DataFrame, w: int, h: int, radius: float = 3.0, sigma_f: float = 1.0, bands=("c0", "c1", "c2")) -> DataFrame:
    """The older weight: pixels numbered row by row, and a spread in space fixed at half weight for a distance of 3."""
    return image_similarity(pixels, w, h, radius, OLD_SIGMA * OLD_SIGMA, sigma_f, bands, "row")


def tof_similarity(frame: DataFrame, w: int, h: int, radius: float = 3.0, sigma_x: float = 1.0, sigma_f: float = 1.0) -> DataFrame:
    """col, row, val of neighbouring pixels of a frame (node, X, Y, Z, I): distance in space over sigma_x, of intensity over sigma_f.

    Coordinates in the image follow from the node's number, column by column.
    """
    places = {"x": F.floor(F.col("node") / h), "y": F.col("node") % h}
    # X and Y of the scene are not x and y of the image, though names don't tell case apart
    named = frame.select(*(c.cast("int").alias(n) for n, c in places.items()), *(F.col(c).alias(f"s{c}") for c in "XYZI"))
    pairs = neighbours(named, radius)
    bright = F.col("p.sI") - F.col("q.sI")
    return _graph(pairs, F.exp(-_distance(("sX", "sY", "sZ")) / F.lit(float(sigma_x)) - bright * bright / F.lit(INTENSITY * INTENSITY * sigma_f)), w, h, "column")


def _exact_gaps(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distance of each row of u to the same row of v: differences in their own type, squares in doubles, summed from the first component to the last."""
    out = np.zeros(len(u))
    for i in range(u.shape[1]):
        d = (u[:, i] - v[:, i]).astype(float)
        out += d * d
    return out


class _Near:
    """Candidates for the k heaviest neighbours of each vector of a block, where weights are compared after rounding.

    A tile's distances come from one matrix product with a bound on its error; those that could be among the heaviest are computed again. No pair that could be chosen is dropped:
    a pair goes if k others are heavier by more than rounding can hide, or have the same rounded weight beyond doubt and smaller ids.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, sigma_f: float):
        self.ids, self.vectors, self.k, self.sigma = ids, vectors, k, sigma_f
        self.wide = vectors.astype(float)
        self.norms = (self.wide * self.wide).sum(1)
        self.floor = np.full(len(ids), np.inf)  # of each: gap beyond which nothing is chosen
        self.at, self.rows, self.gaps = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        wide = vectors.astype(float)
        norms = (wide * wide).sum(1)
        sums = self.norms[:, None] + norms[None, :]
        gaps = sums - 2 * (self.wide @ wide.T)
        error = 1e-6 * np.abs(gaps) + 1e-12 * sums + 1e-30  # floats differ from doubles by less
        own = self.ids[:, None] == ids[None, :]
        floor = self.floor
        if len(ids) >= self.k:
            floor = np.minimum(floor, self._reach(np.partition(gaps + error, self.k - 1, axis=1)[:, self.k - 1]))
        at, of = np.nonzero((gaps - error <= floor[:, None]) | own)
        for i in range(0, len(at), 200_000):
            a, b = at[i : i + 200_000], of[i : i + 200_000]
            self.at, self.rows, self.gaps = np.concatenate([self.at, a]), np.concatenate([self.rows, ids[b]]), np.concatenate([self.gaps, _exact_gaps(self.vectors[a], vectors[b])])
            self._thin()

    def _reach(self, gap: np.ndarray) -> np.ndarray:
        """Gaps over this weigh less than ``gap`` after rounding, too."""
        least = np.exp(-gap / self.sigma) - 1.5 * 10.0**-DIGITS
        with np.errstate(divide="ignore"):
            return np.where(least > 0, -self.sigma * np.log(np.maximum(least, 0)) * (1 + 1e-9), np.inf)

    def _thin(self) -> None:
        order = np.lexsort((self.gaps, self.at))
        at, rows, gaps = self.at[order], self.rows[order], self.gaps[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == self.k - 1
        self.floor[at[last]] = np.minimum(self.floor[at[last]], self._reach(gaps[last]))
        units = np.exp(-gaps / self.sigma) * 10.0**DIGITS
        sure = np.abs(units - np.floor(units) - 0.5) > 1e-3
        own = rows == self.ids[at]
        unit = np.rint(units).astype(np.int64)
        order = np.lexsort((rows, unit, sure, at))
        at, rows, gaps, unit, sure, own = (x[order] for x in (at, rows, gaps, unit, sure, own))
        new = np.r_[True, (at[1:] != at[:-1]) | (unit[1:] != unit[:-1]) | (sure[1:] != sure[:-1])]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        stay = own | ((gaps <= self.floor[at]) & (~sure | (place < self.k)))
        self.at, self.rows, self.gaps = at[stay], rows[stay], gaps[stay]


def knn_candidates(vectors: DataFrame, k: int, sigma_f: float, id_col: str, vec_col: str) -> DataFrame:
    """col, row, gap (squared distance): few pairs that hold the k heaviest neighbours of each vector, and each with itself.

    All pairs are compared, in tiles of packed blocks; of the candidates so many are broadcast at once as ``BROADCAST_BYTES`` allows, in jobs of their own.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = np.dtype("<f8" if dict(vectors.dtypes)[vec_col] == "array<double>" else "<f4")

    def packed(size: int) -> DataFrame:
        def pack(batches):
            ids, rows = [], []
            for b in chain(batches, [None]):
                if b is not None:
                    ids += b.column(0).to_pylist()
                    rows += [np.asarray(x.values.to_numpy(zero_copy_only=False), kind) for x in b.column(1)]
                while ids and (b is None or len(ids) >= size):
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(ids[:size])], pa.int32()), "ids": [np.array(ids[:size], "<i8").tobytes()], "vectors": [np.stack(rows[:size]).tobytes()]})
                    del ids[:size], rows[:size]

        plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
        return scratch.keep(plain.mapInArrow(pack, "n int, ids binary, vectors binary").withColumn("block", F.monotonically_increasing_id()))

    asked, every = packed(ASKED), packed(TILE)
    unpack = lambda ids, values, n: (np.frombuffer(ids, "<i8"), np.frombuffer(values, kind).reshape(n, -1))

    def meet(batches):
        found: dict[int, _Near] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["block"] not in found:
                    found[r["block"]] = _Near(*unpack(r["ids"], r["vectors"], r["n"]), k, sigma_f)
                found[r["block"]].meet(*unpack(r["cids"], r["cvectors"], r["cn"]))
        for x in found.values():
            yield pa.RecordBatch.from_pydict({"col": x.ids[x.at], "row": x.rows, "gap": x.gaps})

    blocks = asked.count()
    sizes = every.select("block", F.octet_length("vectors").alias("b")).orderBy("block").collect()
    groups: list[list[int]] = []
    room = 0
    for block, b in sizes:
        if not groups or room < b:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(block)
        room -= b

    def near(group: list[int]) -> DataFrame:
        few = every.where(F.col("block").between(group[0], group[-1])).select(F.col("n").alias("cn"), F.col("ids").alias("cids"), F.col("vectors").alias("cvectors"))
        return asked.repartition(max(1, blocks), "block").crossJoin(F.broadcast(few)).mapInArrow(meet, "col long, row long, gap double")

    return scratch.gather(near(g) for g in groups)


def knn_graph(vectors: DataFrame, k: int, sigma_f: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Symmetric graph of the k nearest vectors of each (by rounded weight, ties to the smaller id) and a loop, weighted exp(-distance^2 / sigma_f).

    Tables that hold a vector without a distance (null, of another length, with a null or non-finite component) or without an id are compared pair by pair in the engine.
    """
    a = vectors.select(F.col(id_col).alias("col"), F.col(vec_col).alias("u"))
    first = a.first()
    dim = len(first["u"]) if first and first["u"] is not None else 0
    plain = F.col("col").isNotNull() & (F.size("u") == dim) & F.forall("u", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if dim and a.where(~F.coalesce(plain, F.lit(False))).isEmpty():
        pairs = knn_candidates(vectors, k, sigma_f, id_col, vec_col)
    else:
        b = vectors.select(F.col(id_col).alias("row"), F.col(vec_col).alias("v"))
        gap = F.aggregate(F.zip_with("u", "v", lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
        pairs = a.crossJoin(b).select("col", "row", gap.alias("gap"))
    pairs = pairs.select("col", "row", F.round(F.exp(-F.col("gap") / F.lit(float(sigma_f))), DIGITS).alias("val"))
    best = Window.partitionBy("col").orderBy(F.desc("val"), "row")
    kept = pairs.withColumn("n", F.row_number().over(best)).where((F.col("n") <= k) | (F.col("col") == F.col("row"))).select("col", "row", "val")
    return kept.union(kept.select(F.col("row").alias("col"), F.col("col").alias("row"), "val")).distinct()
