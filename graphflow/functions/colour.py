"""Colour spaces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sRGB primaries against D50 white (rows X, Y, Z), and their inverse.
TO_XYZ = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
FROM_XYZ = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
#: XYZ is taken as it is, without division by a white point; pass (0.9642, 1.0, 0.8249) for D50.
WHITE = (1.0, 1.0, 1.0)
#: The linear parts of the sRGB curve and of the Lab curve.
KNEE, SLOPE, GAMMA, SHIFT = 0.04045, 12.92, 2.4, 0.055
DELTA = 6.0 / 29.0


def _expand(c: Column) -> Column:
    return F.when(c <= KNEE, c / SLOPE).otherwise(F.pow((c + SHIFT) / (1 + SHIFT), F.lit(GAMMA)))


def _compress(c: Column) -> Column:
    return F.when(c <= KNEE / SLOPE, c * SLOPE).otherwise((1 + SHIFT) * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / GAMMA)) - SHIFT)


def _curve(t: Column) -> Column:
    return F.when(t > DELTA**3, F.cbrt(t)).otherwise(t / (3 * DELTA**2) + 4.0 / 29.0)


def _uncurve(t: Column) -> Column:
    return F.when(t > DELTA, t * t * t).otherwise(3 * DELTA**2 * (t - 4.0 / 29.0))


def _times(matrix, values: list[Column]) -> list[Column]:
    return [sum((v * k for k, v in zip(row[1:], values[1:], strict=True)), values[0] * row[0]) for row in matrix]


def lab(r: Column, g: Column, b: Column, white=WHITE) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* of red, green and blue in 0..1."""
    x, y, z = (_curve(v / w) for v, w in zip(_times(TO_XYZ, [_expand(c) for c in (r, g, b)]), white, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def rgb(light: Column, a: Column, b: Column, white=WHITE) -> tuple[Column, Column, Column]:
    """Red, green and blue in 0..1 of CIE L*, a*, b*; colours outside are clamped."""
    y = (light + 16) / 116
    xyz = [_uncurve(t) * w for t, w in zip((y + a / 500, y, y - b / 200), white, strict=True)]
    return tuple(F.least(F.greatest(_compress(v), F.lit(0.0)), F.lit(1.0)) for v in _times(FROM_XYZ, xyz))


def rgb_to_lab(pixels: DataFrame, eight_bit: bool = True) -> DataFrame:
    """Bands c0, c1, c2 (0..255) become Lab; with ``eight_bit`` L is stored as 0..255 for 0..128 and a, b as 0..255 for -128..128."""
    values = lab(*(F.col(c) / 255.0 for c in ("c0", "c1", "c2")))
    if eight_bit:
        clamp = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("double")
        values = (clamp(values[0] / 128), clamp((values[1] + 128) / 256), clamp((values[2] + 128) / 256))
    return pixels.withColumns(dict(zip(("c0", "c1", "c2"), values, strict=True)))


def lab_to_rgb(pixels: DataFrame) -> DataFrame:
    """Bands c0, c1, c2 in Lab become red, green and blue in 0..255."""
    return pixels.withColumns({c: v * 255 for c, v in zip(("c0", "c1", "c2"), rgb(F.col("c0"), F.col("c1"), F.col("c2")), strict=True)})


def greyscale(frame: DataFrame, component: str, low: float, high: float) -> DataFrame:
    """node and grey (0..255): a component's values between low and high, clamped."""
    if component not in ("X", "Y", "Z", "I"):
        raise ValueError(f"no such component: {component}")
    if high == low:
        raise ValueError("low and high are equal")
    share = F.least(F.greatest((F.col(component) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return frame.select("node", F.floor(share * 255).cast("int").alias("grey"))


def channel_range(pixels: DataFrame, bands=("c0", "c1", "c2")) -> DataFrame:
    """One row with the smallest and largest value of each band."""
    return pixels.agg(*(f(b).alias(f"{n}_{b}") for b in bands for n, f in (("min", F.min), ("max", F.max))))
