"""Overlays: several channels seen together, images beside them, and what decides on defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number
from tracelake.operators.histogram import cells, raster


def median_centroids(df: DataFrame, by: str, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    return df.groupBy(by).agg(*(F.percentile(number(a), 0.5).alias(a) for a in axes))


def shifted_to_first(df: DataFrame, channel: str = "channel", axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Every channel moved so that its median centroid is the first channel's. Centroids are one row a channel."""
    c = median_centroids(df, channel, axes)
    first = c.orderBy(channel).limit(1).select(*(F.col(a).alias(f"__f{a}") for a in axes))
    moves = c.crossJoin(F.broadcast(first)).select(channel, *((F.col(f"__f{a}") - F.col(a)).alias(f"__d{a}") for a in axes))
    out = df.join(F.broadcast(moves), channel)
    for a in axes:
        out = out.withColumn(a, F.col(a) + F.col(f"__d{a}"))
    return out.drop(*(f"__d{a}" for a in axes))


def geometry_matches(images: DataFrame, regions: DataFrame, tolerance: float) -> DataFrame:
    """``(image, roi, error)``: images whose bounds differ from a region's by at most a share of its size.

    Both are small catalogs with x0 y0 x1 y1; they meet by their rounded centre.
    """
    size = regions.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    reach = size * max(tolerance, 1e-9) + 1e-9
    mid = {k: F.floor((F.col(f"{k}0") + F.col(f"{k}1")) / 2 / reach).cast("long") for k in "xy"}
    a = images.select("image", *(F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")), mid["x"].alias("cx"), mid["y"].alias("cy"))
    b = regions.withColumn("cx", F.explode(F.sequence(mid["x"] - 1, mid["x"] + 1))).withColumn("cy", F.explode(F.sequence(mid["y"] - 1, mid["y"] + 1)))
    off = F.greatest(*(F.abs(F.col(f"i_{c}") - F.col(c)) for c in ("x0", "y0", "x1", "y1")))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return a.join(b, ["cx", "cy"]).select("image", "roi", (off / side).alias("error")).where(F.col("error") <= tolerance)


def box_query(df: DataFrame, x0: float, y0: float, x1: float, y1: float, size: float) -> DataFrame:
    """Points of a table with cell columns i_x, i_y: the cells prune (partitions, row groups), the bounds decide."""
    near = F.col("i_x").between(int(x0 // size), int(x1 // size)) & F.col("i_y").between(int(y0 // size), int(y1 // size))
    return df.where(near & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def write_cells(df: DataFrame, path: str, size: float, block: int = 64) -> None:
    """Points laid out by blocks of cells, so that a box query reads few files."""
    laid = cells(df, size, ("x", "y")).withColumn("b_x", F.floor(F.col("i_x") / block).cast("int"))
    laid.repartitionByRange("b_x", "i_y").sortWithinPartitions("i_x", "i_y").write.partitionBy("b_x").parquet(path)


def two_channel_ratio(df: DataFrame, a: str, b: str, rows: int = 500, tolerance: float = 1e-3) -> DataFrame:
    """One row: do the first rows (in row order) that aren't zero sum to 1?"""
    head = df.where((F.col(a) != 0) | (F.col(b) != 0)).orderBy("row_id").limit(rows)
    return head.agg(F.coalesce(F.max(F.abs(F.col(a) + F.col(b) - 1)) < tolerance, F.lit(False)).alias("two_channels"))


def smoothed_density(df: DataFrame, size: float, sigma: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(i_x, i_y, n, density)``: Gaussian-weighted counts of the cells within three deviations, on occupied cells."""
    reach = int(3 * sigma)
    grid = raster(df, size, axes)
    spread = grid
    for a in axes:
        spread = spread.withColumn(f"d_{a}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    d2 = sum((F.pow(F.col(f"d_{a}"), 2) for a in axes[1:]), F.pow(F.col(f"d_{axes[0]}"), 2))
    keys = [f"i_{a}" for a in axes]
    moved = spread.select(*((F.col(f"i_{a}") + F.col(f"d_{a}")).cast("long").alias(f"i_{a}") for a in axes), (F.col("n") * F.exp(-d2 / (2 * sigma**2))).alias("w"))
    return grid.join(moved.groupBy(*keys).agg(F.sum("w").alias("density")), keys)


def density_method(points: int, area: float, radius: float, exact_work: float = 5e9, neighbours: float = 5e4) -> str:
    """``exact`` where the expected neighbours and work allow it, ``voxel`` else."""
    around = points * 3.141592653589793 * radius**2 / max(area, 1e-12)
    return "exact" if around <= neighbours and around * points <= exact_work else "voxel"


def smallest_type(most: int) -> str:
    return next(name for name, top in (("uint8", 2**8), ("uint16", 2**16), ("uint32", 2**32), ("uint64", 2**64)) if most < top)


def preview_rows(n: int, head: int = 10) -> list[int]:
    """A dense head, then 1-2-5 steps, and the last row."""
    out, step = list(range(min(head, n))), 10
    while step < n:
        out += [k * step for k in (1, 2, 5) if k * step < n]
        step *= 10
    return sorted({*out, *([n - 1] if n else [])})


def bounds(df: DataFrame, by: str) -> DataFrame:
    """``(by, x0, y0, x1, y1)`` over rectangles."""
    return df.groupBy(by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
