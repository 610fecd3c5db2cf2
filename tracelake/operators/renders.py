"""Renders from rows: Gaussians by precision integrated over pixels, pixel coordinates, contrast levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rational approximation 7.1.26 of Abramowitz and Stegun, whose error is below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


#: Fixed value: the least sigma of a rendered row.
LEAST_SIGMA = 1e-3


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def pixel_share(low: Column, size: float | Column, at: Column, sigma: Column) -> Column:
    """The mass of a Gaussian between ``low`` and ``low + size``."""
    scale = sigma * math.sqrt(2)
    return (erf((low + size - at) / scale) - erf((low - at) / scale)) / 2


def precision_render(points: DataFrame, size: float, sigma_x: Column, sigma_y: Column, reach: float = 4.0, least: float = LEAST_SIGMA) -> DataFrame:
    """``(ix, iy, v)``: each row spreads one unit over the pixels that its ``reach`` sigmas touch, by the Gaussian's mass in each, scaled to one in all.

    Sigmas are ``least`` or more; rows with a number that isn't finite are left
    out.  A row makes as many pixels as its own footprint has; they are summed
    in the map tasks first.
    """
    rows = points.select("x", "y", F.greatest(sigma_x, F.lit(least)).alias("sx"), F.greatest(sigma_y, F.lit(least)).alias("sy"))
    for c in ("x", "y", "sx", "sy"):
        rows = rows.where(F.abs(c) < float("inf"))
    for c, s in (("x", "sx"), ("y", "sy")):
        first, end = F.floor((F.col(c) - reach * F.col(s)) / size), F.ceil((F.col(c) + reach * F.col(s)) / size)
        rows = rows.withColumn(f"f{c}", first).withColumn(f"e{c}", end).withColumn(f"m{c}", pixel_share(F.col(f"f{c}") * size, size * (F.col(f"e{c}") - F.col(f"f{c}")), F.col(c), F.col(s)))
    across = rows.withColumn("ix", F.explode(F.sequence("fx", F.col("ex") - 1)))
    across = across.select("ix", "y", "sy", "fy", "ey", "my", (pixel_share(F.col("ix") * size, size, F.col("x"), F.col("sx")) / F.col("mx")).alias("wx"))
    cells = across.withColumn("iy", F.explode(F.sequence("fy", F.col("ey") - 1)))
    return cells.groupBy("ix", "iy").agg(F.sum(F.col("wx") * pixel_share(F.col("iy") * size, size, F.col("y"), F.col("sy")) / F.col("my")).alias("v"))


def pixel_coordinates(x: Column, y: Column, origin: Sequence[float], size: Sequence[float]) -> tuple[Column, Column]:
    """Stage coordinates as continuous pixel columns and rows; pixel centres are whole numbers."""
    return (x - origin[0]) / size[0] - 0.5, (y - origin[1]) / size[1] - 0.5


def moved_pixels(col: Column, row: Column, degrees: float, scale: float, shift: Sequence[float], centre: Sequence[float]) -> tuple[Column, Column]:
    """Pixel coordinates turned about a centre, scaled and shifted. Rows run downwards, so a turn to the left lifts what lies to the right."""
    a = math.radians(degrees)
    dx, dy = col - centre[0], row - centre[1]
    return (
        scale * (dx * math.cos(a) + dy * math.sin(a)) + centre[0] + shift[0],
        scale * (dy * math.cos(a) - dx * math.sin(a)) + centre[1] + shift[1],
    )


def contrast_levels(pixels: DataFrame, value: str = "n", bins: int = 256, part: int = 5000) -> DataFrame:
    """``(low, high)``: the lower edges of the first and the last bin of the values' histogram that hold more than 1 / ``part`` of the pixels.

    Bins with more than a tenth of the pixels, the background, count as empty.
    Without such bins, or where both are one, it is the whole range; values all
    alike get a range of one, and fewer than ten pixels none.
    """
    v = F.col(value).cast("double")
    finite = pixels.select(v.alias("v")).where(F.abs("v") < float("inf"))
    ends = finite.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"))
    step = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(step > 0, F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0)
    counts = finite.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin"), "lo", "hi", "total").agg(F.count(F.lit(1)).alias("k"))
    shown = F.when((F.col("k") <= F.floor(F.col("total") / 10)) & (F.col("k") > F.floor(F.col("total") / part)), F.col("bin"))
    one = counts.groupBy("lo", "hi", "total").agg(F.min(shown).alias("first"), F.max(shown).alias("last")).where("total >= 10")
    cut = F.col("last") > F.col("first")
    low, high = (F.when(cut, F.col("lo") + F.col(c) * step).otherwise(F.col(e)) for c, e in (("first", "lo"), ("last", "hi")))
    return one.select(low.alias("low"), F.when(F.col("hi") > F.col("lo"), high).otherwise(F.col("lo") + 1).alias("high"))


def edges(lo: Column, hi: Column, step: float) -> Column:
    """The edges of bins from lo, so that hi lies inside the last one; one bin for a range without extent."""
    if not 0 < step < math.inf:
        raise ValueError("the step must be positive and finite")
    bins = F.when((hi > lo) & (hi - lo < float("inf")), F.floor((hi - lo) / step) + 1).otherwise(1)
    return F.transform(F.sequence(F.lit(0), bins.cast("int")), lambda k: lo + k * step)


def voxel_size(extent: Sequence[float], most: int, sizes: Sequence[float]) -> float:
    """The smallest of some sizes at which an extent has no more than ``most`` voxels; the largest if none."""
    fit = [s for s in sorted(sizes) if math.prod(max(1, math.ceil(e / s)) for e in extent) <= most]
    return fit[0] if fit else max(sizes)
