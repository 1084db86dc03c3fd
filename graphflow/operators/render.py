"""Segmented images as pixel tables: boundaries, mean colours, contrast and outlines.

Pixels are (x, y, c0, c1, c2), clusters (node, cluster) with node = frame * w * h + x * h + y. Boundaries are found where
a pixel is: its cluster is sent to the four places beside it, and one grouping by place brings them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphflow.functions import colour

#: East, west, then greater and smaller y: the order in which a differing neighbour is looked for.
SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def places(c: DataFrame, w: int, h: int) -> DataFrame:
    """frame, x, y, cluster of every node."""
    inner = F.col("node") % (w * h)
    return c.select(F.floor(F.col("node") / (w * h)).cast("int").alias("frame"), F.floor(inner / h).cast("int").alias("x"), (inner % h).cast("int").alias("y"), "cluster")


def surroundings(c: DataFrame, w: int, h: int) -> DataFrame:
    """frame, x, y, cluster and s0..s3: the clusters of the four neighbours in the order of SIDES, null outside the image."""
    here = places(c, w, h)
    sent = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("dx"), F.lit(0).alias("dy")), *(F.struct(F.lit(k).alias("k"), F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy")) for k, (dx, dy) in enumerate(SIDES)))
    told = here.select("frame", "x", "y", "cluster", F.explode(sent).alias("o"))
    told = told.select("frame", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "cluster", F.col("o.k").alias("k"))
    own = F.max(F.when(F.col("k") == -1, F.col("cluster")))
    by = told.groupBy("frame", "x", "y").agg(own.alias("cluster"), *(F.max(F.when(F.col("k") == k, F.col("cluster"))).alias(f"s{k}") for k in range(4)))
    return by.where("cluster is not null")


def boundary(c: DataFrame, w: int, h: int) -> DataFrame:
    """frame, x, y, cluster, is_boundary, neighbour: the first differing cluster among the four neighbours, null if none."""
    around = surroundings(c, w, h)
    differing = F.coalesce(*(F.when(F.col(f"s{k}") != F.col("cluster"), F.col(f"s{k}")) for k in range(4)))
    return around.select("frame", "x", "y", "cluster", differing.isNotNull().alias("is_boundary"), differing.alias("neighbour"))


def cluster_colours(pixels: DataFrame, c: DataFrame, w: int, h: int) -> DataFrame:
    """cluster, size, m0..m2 (mean colour), spread (summed distance of its pixels to the mean)."""
    own = pixels.join(places(c, w, h).where("frame = 0"), ["x", "y"])
    mean = own.groupBy("cluster").agg(F.count("*").alias("size"), *(F.avg(f"c{k}").alias(f"m{k}") for k in range(3)))
    gap = F.sqrt(sum(((F.col(f"c{k}") - F.col(f"m{k}")) * (F.col(f"c{k}") - F.col(f"m{k}")) for k in (1, 2)), (F.col("c0") - F.col("m0")) * (F.col("c0") - F.col("m0"))))
    spread = own.join(mean, "cluster").groupBy("cluster").agg(F.sum(gap).alias("spread"))
    return mean.join(spread, "cluster")


def contrast(pixels: DataFrame, c: DataFrame, w: int, h: int, lab: bool = True) -> DataFrame:
    """x, y, contrast: ten times the distance between the mean colours of a boundary pixel's cluster and its neighbour, clamped to 255; 0 inside.

    Red, green and blue become eight-bit Lab first; without ``lab`` the bands are taken as they are.
    """
    pixels = colour.rgb_to_lab(pixels) if lab else pixels
    mean = cluster_colours(pixels, c, w, h)
    own = mean.select("cluster", *(f"m{k}" for k in range(3)))
    other = mean.select(F.col("cluster").alias("neighbour"), *(F.col(f"m{k}").alias(f"o{k}") for k in range(3)))
    at = boundary(c, w, h).where("frame = 0").join(own, "cluster").join(other, "neighbour", "left")
    gap = 10 * F.sqrt(sum(((F.col(f"m{k}") - F.col(f"o{k}")) * (F.col(f"m{k}") - F.col(f"o{k}")) for k in (1, 2)), (F.col("m0") - F.col("o0")) * (F.col("m0") - F.col("o0"))))
    return at.select("x", "y", F.when(F.col("is_boundary"), F.least(gap, F.lit(255.0))).otherwise(0.0).alias("contrast"))


def outline(pixels: DataFrame, c: DataFrame, w: int, h: int, line: float = 1.0, hq: bool = False) -> DataFrame:
    """frame, x, y, c0..c2: pixels inside a cluster keep their colour, those at a boundary get grey ``line`` * 255.

    With ``hq`` the image has twice the size, and of the four parts of a pixel only those beside a differing neighbour get the line's colour.
    ``pixels`` may have a column frame; without it all frames show the same image.
    """
    around = surroundings(c, w, h)
    joined = around.join(pixels, ["frame", "x", "y"] if "frame" in pixels.columns else ["x", "y"])
    grey = F.lit(255.0 * line)
    differs = [F.coalesce(F.col(f"s{k}") != F.col("cluster"), F.lit(False)) for k in range(4)]
    if not hq:
        at_line = differs[0] | differs[1] | differs[2] | differs[3]
        return joined.select("frame", "x", "y", *(F.when(at_line, grey).otherwise(F.col(f"c{k}")).alias(f"c{k}") for k in range(3)))
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (differs[0 if i else 1] | differs[2 if j else 3]).alias("l")) for i in (0, 1) for j in (0, 1)))
    quarters = joined.select("frame", "x", "y", "c0", "c1", "c2", F.explode(parts).alias("q"))
    return quarters.select(
        "frame", (2 * F.col("x") + F.col("q.i")).alias("x"), (2 * F.col("y") + F.col("q.j")).alias("y"),
        *(F.when(F.col("q.l"), grey).otherwise(F.col(f"c{k}")).alias(f"c{k}") for k in range(3)),
    )


def flat_colours(c: DataFrame, w: int, h: int, seed: int = 0) -> DataFrame:
    """x, y, grey: one grey for each cluster, made from its number by a fixed rule."""
    grey = F.pmod(F.col("cluster") * 2654435761 + seed * 40503, F.lit(4294967296)) % 256
    return places(c, w, h).where("frame = 0").select("x", "y", grey.cast("int").alias("grey"))
