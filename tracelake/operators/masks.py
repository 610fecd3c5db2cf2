"""Masks of pixel rasters as runs, their morphology, components and exact distances to the border.

A mask is a table of runs ``(i_y, a, b)``: the pixels a to b of a row.  Growing
by a disk widens the runs of the rows around and unites what overlaps; shrinking
is growing the complement.  Components join runs of neighbouring rows that
overlap.  The exact Euclidean distance takes two passes: how far each pixel is
from the end of its column's run, then the least over the pixels of its row's
run, which ends where the background is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.graph import components
from tracelake.operators.histogram import otsu
from tracelake.storage import release, stored

SPAN = 1 << 31
BLOCK = 64  # pixels of a row that runs are dealt by to meet


@dataclass(frozen=True)
class Frame:
    """The pixels of an image: the first and the last of each axis."""

    x0: int
    x1: int
    y0: int
    y1: int

    def grown(self, n: int) -> Frame:
        return Frame(self.x0 - n, self.x1 + n, self.y0 - n, self.y1 + n)


def united(runs: DataFrame) -> DataFrame:
    """Runs that overlap or touch as one."""
    before = Window.partitionBy("i_y").orderBy("a", "b")
    reach = F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.select("i_y", "a", "b", F.when(F.col("a") <= reach + 1, 0).otherwise(1).alias("new"))
    return begun.withColumn("g", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy("i_y", "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")


def runs_of(pixels: DataFrame) -> DataFrame:
    """The runs of a table of pixels (i_x, i_y)."""
    return united(pixels.select("i_y", F.col("i_x").alias("a"), F.col("i_x").alias("b")).distinct())


def pixels_of(runs: DataFrame) -> DataFrame:
    return runs.select("i_y", *(c for c in runs.columns if c not in ("i_y", "a", "b")), F.explode(F.sequence("a", "b")).alias("i_x"))


def grown(runs: DataFrame, radius: int, frame: Frame) -> DataFrame:
    """By all pixels within ``radius``, inside the frame."""
    wide = F.floor(F.sqrt(F.lit(radius**2) - F.col("dy") * F.col("dy")) + 1e-9).cast("long")
    around = runs.withColumn("dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    moved = around.select((F.col("i_y") + F.col("dy")).alias("i_y"), F.greatest(F.col("a") - wide, F.lit(frame.x0)).alias("a"), F.least(F.col("b") + wide, F.lit(frame.x1)).alias("b"))
    return united(moved.where(F.col("i_y").between(frame.y0, frame.y1) & (F.col("a") <= F.col("b"))))


def complement(runs: DataFrame, frame: Frame) -> DataFrame:
    """The pixels of the frame that aren't in the runs, which lie apart and inside it."""
    rows = runs.sparkSession.range(frame.y0, frame.y1 + 1).select(F.col("id").alias("i_y"))
    after = rows.select("i_y", F.lit(frame.x1 + 1).cast("long").alias("a"), F.lit(frame.x1 + 1).cast("long").alias("b")).unionByName(runs.select("i_y", "a", "b"))
    last = F.coalesce(F.lag("b").over(Window.partitionBy("i_y").orderBy("a")), F.lit(frame.x0 - 1))
    return after.select("i_y", (last + 1).alias("a"), (F.col("a") - 1).alias("b")).where("a <= b")


def shrunk(runs: DataFrame, radius: int, frame: Frame) -> DataFrame:
    """To the pixels with nothing but mask within ``radius``; beyond the frame there is none."""
    outer = frame.grown(radius)
    return complement(grown(complement(runs, outer), radius, frame), frame)


def closed(runs: DataFrame, radius: int, frame: Frame) -> DataFrame:
    return shrunk(grown(runs, radius, frame), radius, frame)


def opened(runs: DataFrame, radius: int, frame: Frame) -> DataFrame:
    return grown(shrunk(runs, radius, frame), radius, frame)


def labelled(runs: DataFrame) -> DataFrame:
    """``(i_y, a, b, label)``: runs that touch by sides, up or down, share a label, their component's first pixel by x, then y."""
    at = stored(runs.select("i_y", "a", "b", ((F.col("i_y") + SPAN // 2) * SPAN + F.col("a") + SPAN // 2).alias("id")), "runs")
    block = F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor(F.col("b") / BLOCK))).alias("block")
    low = at.select(F.col("id").alias("p"), "i_y", F.col("a").alias("a1"), F.col("b").alias("b1"), block)
    high = at.select(F.col("id").alias("q"), (F.col("i_y") - 1).alias("i_y"), F.col("a").alias("a2"), F.col("b").alias("b2"), block)
    links = low.join(high, ["i_y", "block"]).where("a1 <= b2 AND a2 <= b1").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    found = at.join(components(at.select("id"), links), "id")
    first = found.groupBy("component").agg(F.min(F.struct("a", "i_y")).alias("f"))
    return found.join(first, "component").select("i_y", "a", "b", ((F.col("f.a") + SPAN // 2) * SPAN + F.col("f.i_y") + SPAN // 2).alias("label"))


def filled(runs: DataFrame, frame: Frame) -> DataFrame:
    """With the holes: parts of the background that don't reach the frame's edge."""
    outside = labelled(complement(runs, frame))
    edge = (F.col("i_y") == frame.y0) | (F.col("i_y") == frame.y1) | (F.col("a") == frame.x0) | (F.col("b") == frame.x1)
    open_ = outside.where(edge).select("label").distinct()
    return united(runs.select("i_y", "a", "b").unionByName(outside.join(open_, "label", "left_anti").select("i_y", "a", "b")))


def distances(runs: DataFrame) -> DataFrame:
    """``(i_x, i_y, d)``: the Euclidean distance of each mask pixel to the nearest pixel outside the mask."""
    column = Window.partitionBy("i_x").orderBy("i_y")
    px = pixels_of(runs.select("i_y", "a", "b")).withColumn("g", F.col("i_y") - F.row_number().over(column))
    run = Window.partitionBy("i_x", "g")
    down = F.least(F.col("i_y") - F.min("i_y").over(run), F.max("i_y").over(run) - F.col("i_y")) + 1
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return px.select("i_x", "i_y", down.alias("down")).repartition(parts, "i_y").groupBy("i_y").applyInPandas(_row_distances, "i_x long, i_y long, d double")


def _row_distances(pdf: pd.DataFrame) -> pd.DataFrame:
    """The second pass: the background beyond a run's ends is at no height, so other rows' pixels count only inside the run."""
    pdf = pdf.sort_values("i_x", ignore_index=True)
    x, height = pdf["i_x"].to_numpy(), pdf["down"].to_numpy().astype(np.int64) ** 2
    new = np.diff(x, prepend=x[0] - 2) != 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(x)) - 1
    which = np.cumsum(new) - 1
    edge = np.minimum(x - x[starts][which], x[ends][which] - x) + 1
    best = np.minimum(height, edge**2)
    step = 1
    while step * step < best.max():
        for sign in (-1, 1):
            other = np.arange(len(x)) + sign * step
            ok = (other >= 0) & (other < len(x))
            ok[ok] = which[other[ok]] == which[ok]
            best[ok] = np.minimum(best[ok], height[other[ok]] + step * step)
        step += 1
    return pdf[["i_x", "i_y"]].assign(d=np.sqrt(best))


def blurred(image: DataFrame, sigma: float, frame: Frame) -> DataFrame:
    """A sparse image (i_x, i_y, v) smoothed by a Gaussian, cut at four sigma and mirrored at the frame."""
    if sigma <= 0:
        return image
    reach = int(4 * sigma + 0.5)
    g = np.exp(-((np.arange(-reach, reach + 1) / sigma) ** 2) / 2)
    taps = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(float(w)).alias("w")) for o, w in zip(range(-reach, reach + 1), g / g.sum(), strict=True)))
    for c, other, lo, hi in (("i_x", "i_y", frame.x0, frame.x1), ("i_y", "i_x", frame.y0, frame.y1)):
        period = 2 * (hi - lo + 1)
        turn = F.pmod(F.col(c) - lo + F.col("t.o"), F.lit(period))
        each = image.withColumn("t", F.explode(taps))
        image = each.select(other, (lo + F.least(turn, period - 1 - turn)).alias(c), (F.col("v") * F.col("t.w")).alias("v")).groupBy(other, c).agg(F.sum("v").alias("v"))
    return image


def otsu_level(image: DataFrame, frame: Frame, bins: int = 256) -> float | None:
    """The middle of the bin at which a sparse image splits best, its missing pixels being zeros; None without a pixel."""
    lo, hi, n = image.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not n:
        return None
    zeros = (frame.x1 - frame.x0 + 1) * (frame.y1 - frame.y0 + 1) - n
    lo = min(lo, 0.0) if zeros else lo
    width = (hi - lo) / bins
    if not width > 0:
        return lo
    counts = image.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    none = image.sparkSession.range(1).select(F.lit(min(int(-lo / width), bins - 1)).cast("long").alias("bin"), F.lit(zeros).cast("long").alias("n"))
    return lo + (otsu(counts.unionAll(none).groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0")).first()["bin"] + 0.5) * width


@dataclass
class Cells:
    """Cells of a plane of points: ``pixels`` (i_x, i_y, label, edge, half_width, inside), edge being the distance to the border; the origin and the size of pixels."""

    pixels: DataFrame
    origin: tuple[float, float]
    size: float

    def of(self, points: DataFrame) -> DataFrame:
        """``(id, cell, edge, border)``: each point's cell, null outside of all, its distance to the border, and whether it is too near to it."""
        index = [F.floor((F.col(c) - o) / self.size).cast("long").alias(f"i_{c}") for c, o in zip("xy", self.origin, strict=True)]
        at = points.select("id", *index).join(self.pixels, ["i_x", "i_y"], "left")
        return at.select("id", F.col("label").alias("cell"), F.coalesce("edge", F.lit(0.0)).alias("edge"), (~F.coalesce("inside", F.lit(False))).alias("border"))

    def table(self) -> DataFrame:
        """``(cell, area, half_width)``."""
        return self.pixels.groupBy(F.col("label").alias("cell")).agg((F.count(F.lit(1)) * self.size**2).alias("area"), F.max("half_width").alias("half_width"))


def cells(
    points: DataFrame,
    border: float = 200.0,
    share: float | None = None,
    size: float = 20.0,
    smooth: float = 60.0,
    close: float = 120.0,
    open_: float = 0.0,
    min_area: float = 50_000.0,
) -> Cells:
    """Cells delineated by the density of points (id, x, y).

    The smoothed raster is cut by Otsu's level, closed, filled, opened where
    asked for, and rid of components under ``min_area``.  Inside is what lies at
    least ``border`` from a cell's border, or ``share`` of the cell's half width.
    """
    if size <= 0:
        raise ValueError("pixels must have a size")
    finite = points.select("x", "y").where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    x0, x1, y0, y1 = finite.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    spark: SparkSession = points.sparkSession
    if x0 is None:
        none = "i_x long, i_y long, label long, edge double, half_width double, inside boolean"
        return Cells(spark.createDataFrame([], none), (0.0, 0.0), size)
    pad = max(10 * size, 2 * close, 2 * smooth)
    origin = (x0 - pad, y0 - pad)
    nx, ny = (math.ceil((hi - lo + 2 * pad + size) / size - 1e-9) - 1 for lo, hi in ((x0, x1), (y0, y1)))
    frame = Frame(0, nx - 1, 0, ny - 1)
    index = [F.least(F.floor((F.col(c) - o) / size), F.lit(m)).cast("long").alias(f"i_{c}") for c, o, m in (("x", origin[0], nx - 1), ("y", origin[1], ny - 1))]
    image = stored(blurred(finite.groupBy(*index).agg(F.count(F.lit(1)).cast("double").alias("v")), smooth / size, frame), "density")
    runs = runs_of(image.where(F.col("v") > otsu_level(image, frame)))
    for radius, change in ((round(close / size), closed), (0, None), (round(open_ / size), opened)):
        if change is None:
            runs = filled(runs, frame)
        elif radius >= 1:
            runs = stored(change(runs, radius, frame), "mask")
    parts = stored(labelled(runs), "cells")
    large = parts.groupBy("label").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n")).where(F.col("n") * size * size >= min_area).select("label")
    kept = stored(parts.join(large, "label", "left_semi"), "cells")
    far = distances(kept).select("i_x", "i_y", (F.col("d") * size).alias("edge"))
    at = stored(pixels_of(kept).join(far, ["i_x", "i_y"]), "cell-pixels")
    widths = at.groupBy("label").agg(F.max("edge").alias("half_width"))
    least = F.lit(float(border)) if share is None else share * F.col("half_width")
    px = stored(at.join(widths, "label").select("i_x", "i_y", "label", "edge", "half_width", (F.col("edge") >= least).alias("inside")), "cell-pixels")
    release(image, parts, kept, at)
    return Cells(px, origin, size)
