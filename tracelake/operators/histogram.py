"""Histograms, rasters, pyramids and thresholds as grouped counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number, percentiles


def bin_of(v: Column, lo: Column, width: Column, bins: Column) -> Column:
    """Half-open bins of equal width, the last one closed."""
    return F.least(F.floor((v - lo) / width), bins - 1).cast("long")


def histogram(df: DataFrame, value: str, bins: int | None = None, by: Sequence[str] = (), max_bins: int = 4096) -> DataFrame:
    """``(*by, bin, lo, hi, n)``; without ``bins`` the width is 2 IQR / n^(1/3), or the span / sqrt(n) where that is 0.

    The edges come from one aggregate row over all groups, which is broadcast.
    """
    df = df.select(*by, number(value).alias("v")).where("v IS NOT NULL")
    s = df.agg(F.min("v").alias("lo"), F.max("v").alias("top"), F.count("v").alias("n"), percentiles(F.col("v"), 0.25, 0.75).alias("q"))
    wide = 2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt("n")
    wide = F.when(wide > 0, wide).otherwise((F.col("top") - F.col("lo")) / F.sqrt("n"))
    count = F.lit(bins) if bins else F.when(wide > 0, F.least(F.greatest(F.ceil((F.col("top") - F.col("lo")) / wide), F.lit(1)), F.lit(max_bins))).otherwise(1)
    s = s.select("lo", "top", count.cast("long").alias("bins"))
    s = s.withColumn("w", F.when(F.col("top") > F.col("lo"), (F.col("top") - F.col("lo")) / F.col("bins")).otherwise(1.0))
    out = df.crossJoin(F.broadcast(s)).withColumn("bin", bin_of(F.col("v"), F.col("lo"), F.col("w"), F.col("bins")))
    edge = lambda k: F.col("lo") + F.col("w") * k
    return out.groupBy(*by, "bin", "lo", "w").agg(F.count(F.lit(1)).alias("n")).select(*by, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), "n")


def cells(df: DataFrame, size: float, axes: Sequence[str], origin: float = 0.0) -> DataFrame:
    """``i_<axis>``: grid cells; a value within 1e-9 of an edge counts as on it."""
    for a in axes:
        q = (F.col(a) - origin) / size
        near = F.when(F.abs(q - F.round(q)) < 1e-9, F.round(q)).otherwise(F.floor(q).cast("double"))
        df = df.withColumn(f"i_{a}", near.cast("long"))
    return df


def raster(df: DataFrame, size: float, axes: Sequence[str] = ("x", "y"), value: str | None = None) -> DataFrame:
    """``(i_x, i_y, .., n[, mean])``: counts by cell, and the mean of a value."""
    keys = [f"i_{a}" for a in axes]
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.avg(number(value)).alias("mean")] if value else [])
    return cells(df, size, axes).groupBy(*keys).agg(*aggs)


def cell_density(df: DataFrame, size: float, axes: Sequence[str]) -> DataFrame:
    """``den``: the number of points in each point's own cell."""
    keys = [f"i_{a}" for a in axes]
    gridded = cells(df, size, axes)
    counts = gridded.groupBy(*keys).agg(F.count(F.lit(1)).alias("den"))  # pre-aggregated, so that a dense cell isn't one window
    return gridded.join(counts, keys).drop(*keys)


def pyramid(grid: DataFrame, levels: int, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(level, i_x, i_y, n)``: sums of 2x2 blocks, level by level, all from one pass over the base grid."""
    each = grid.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    up = [F.floor(F.col(f"i_{a}") / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias(f"i_{a}") for a in axes]
    return each.select("level", *up, "n").groupBy("level", *(f"i_{a}" for a in axes)).agg(F.sum("n").alias("n"))


def slab(volume: DataFrame, lo: int, hi: int) -> DataFrame:
    """``(i_x, i_y, mip, total)`` of the voxels with lo <= i_z <= hi."""
    return volume.where(F.col("i_z").between(lo, hi)).groupBy("i_x", "i_y").agg(F.max("n").alias("mip"), F.sum("n").alias("total"))


def otsu(hist: DataFrame) -> DataFrame:
    """``(bin, between)``: the cut (this bin and all below against the rest) of largest between-class variance. hist: (bin, n)."""
    h = hist.select("bin", F.col("n").cast("double").alias("n"))  # at most max_bins rows
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = h.agg(F.sum("n").alias("tn"), F.sum(F.col("bin") * F.col("n")).alias("tm"))
    s = h.select("bin", F.sum("n").over(below).alias("w0"), F.sum(F.col("bin") * F.col("n")).over(below).alias("m0")).crossJoin(F.broadcast(total))
    w1 = F.col("tn") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("tm") - F.col("m0")) / w1
    return s.where(w1 > 0).select("bin", (F.col("w0") * w1 * gap * gap).alias("between")).orderBy(F.desc("between"), "bin").limit(1)


def stretch(df: DataFrame, value: str, levels: int = 256, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``level``: values between two percentiles spread over 0 to levels - 1, clamped outside."""
    q = df.agg(percentiles(F.col(value), low, high).alias("q")).select(F.col("q")[0].alias("__a"), F.col("q")[1].alias("__b"))
    v = (F.col(value) - F.col("__a")) / F.greatest(F.col("__b") - F.col("__a"), F.lit(1e-300)) * (levels - 1)
    return df.crossJoin(F.broadcast(q)).withColumn("level", F.greatest(F.lit(0.0), F.least(F.lit(float(levels - 1)), F.rint(v))).cast("int")).drop("__a", "__b")


def taps(kind: str, offset: Column) -> list[tuple[int, Column]]:
    """(pixel step, weight) of a one-dimensional splat at a fractional pixel offset."""
    t = offset
    if kind == "bilinear":
        return [(0, 1 - t), (1, t)]
    if kind == "bicubic":  # Catmull-Rom
        return [
            (-1, (-t + 2 * t * t - t * t * t) / 2),
            (0, (2 - 5 * t * t + 3 * t * t * t) / 2),
            (1, (t + 4 * t * t - 3 * t * t * t) / 2),
            (2, (-t * t + t * t * t) / 2),
        ]
    raise ValueError(f"no splat {kind!r}")


def splat(df: DataFrame, size: float, kind: str) -> DataFrame:
    """``(i_x, i_y, w)``: every point spread over the pixels around it; the weights of a point sum to 1."""
    px, py = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    df = df.select(F.floor(px).alias("bx"), F.floor(py).alias("by"), (px - F.floor(px)).alias("tx"), (py - F.floor(py)).alias("ty"))
    parts = [
        F.struct((F.col("bx") + i).cast("long").alias("i_x"), (F.col("by") + j).cast("long").alias("i_y"), (wx * wy).alias("w"))
        for i, wx in taps(kind, F.col("tx"))
        for j, wy in taps(kind, F.col("ty"))
    ]
    return df.select(F.explode(F.array(*parts)).alias("t")).groupBy("t.i_x", "t.i_y").agg(F.sum("t.w").alias("w"))


def kernel_count(grid: DataFrame, radius_cells: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(i_x, i_y, around)``: for each occupied cell the points in all cells whose centres lie within a radius."""
    r = math.floor(radius_cells)
    side = F.sequence(F.lit(-r), F.lit(r))
    shifted = grid
    for a in axes:
        shifted = shifted.withColumn(f"d_{a}", F.explode(side))
    near = sum((F.pow(F.col(f"d_{a}"), 2) for a in axes[1:]), F.pow(F.col(f"d_{axes[0]}"), 2)) <= radius_cells**2
    keys = [(F.col(f"i_{a}") + F.col(f"d_{a}")).cast("long").alias(f"i_{a}") for a in axes]
    sums = shifted.where(near).select(*keys, "n").groupBy(*(f"i_{a}" for a in axes)).agg(F.sum("n").alias("around"))
    return grid.join(sums, [f"i_{a}" for a in axes]).select(*(f"i_{a}" for a in axes), "n", "around")


def auto_levels(pixels: DataFrame, total_pixels: int, value: str = "n") -> DataFrame:
    """``(black, white)``: white is the 95th percentile of positive pixels; black 0 with background, else the 1st."""
    s = pixels.where(F.col(value) > 0).agg(percentiles(F.col(value).cast("double"), 0.01, 0.95).alias("q"), F.count(F.lit(1)).alias("k"))
    return s.select(F.when(F.col("k") < total_pixels, 0.0).otherwise(F.col("q")[0]).alias("black"), F.col("q")[1].alias("white"))
