"""Template detection in volumes: voxels on tiles with a margin, suppression over the whole.

Spark counts points by voxel and deals occupied voxels to tiles; a tile's margin
holds all that reaches its own voxels, so peaks don't depend on the tile size.
Only tiles near an occupied voxel are computed.  The scale of the responses is
their maximum over all tiles; then peaks too near to a stronger one go, in
rounds over a grid, as if the strongest were taken first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.spatial import apart
from tracelake.storage import release, stored

#: Full width at half maximum of a Gaussian of sigma 1.
FWHM = 2.3548200450309493


@dataclass(frozen=True)
class Model:
    """A shape: its parameters with their defaults, half the kernel's extent, its profile by distance, and its size."""

    defaults: dict[str, float]
    extent: Callable[[dict], float]
    profile: Callable[[np.ndarray, dict], np.ndarray]
    size: Callable[[dict], float]


def _log_sigma(p: dict) -> float:
    return p["diameter"] / (2 * math.sqrt(3))


#: Lengths in the units of the points.
MODELS = {
    "shell": Model({"diameter": 100.0, "rim": 20.0}, lambda p: p["diameter"], lambda r, p: np.exp(-np.abs(r**2 - (p["diameter"] / 2) ** 2) / (2 * p["rim"]) ** 2), lambda p: p["diameter"]),
    "ball": Model({"diameter": 80.0, "edge": 8.0}, lambda p: p["diameter"] / 2 + 3 * p["edge"], lambda r, p: (1 - np.tanh((r - p["diameter"] / 2) / p["edge"])) / 2, lambda p: p["diameter"]),
    "gaussian": Model({"fwhm": 40.0}, lambda p: 3 * p["fwhm"] / FWHM, lambda r, p: np.exp(-((r * FWHM / p["fwhm"]) ** 2) / 2), lambda p: p["fwhm"]),
    "log": Model({"diameter": 60.0}, lambda p: 3.5 * _log_sigma(p), lambda r, p: (3 - (r / _log_sigma(p)) ** 2) * np.exp(-((r / _log_sigma(p)) ** 2) / 2), lambda p: p["diameter"]),
}


def model(name: str, params: dict | None = None) -> tuple[Model, dict]:
    if name not in MODELS:
        raise ValueError(f"no model {name!r}; there are {', '.join(MODELS)}")
    known = MODELS[name].defaults
    if unknown := set(params or {}) - set(known):
        raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
    return MODELS[name], known | {k: float(v) for k, v in (params or {}).items()}


def kernel(name: str, params: dict | None, pixel: float, z_pixel: float, zero_mean: bool = True) -> np.ndarray:
    """The shape sampled at voxels, of unit norm and, if asked for, of mean zero."""
    shape, p = model(name, params)
    axes = []
    for size in (pixel, pixel, z_pixel):
        half = max(shape.extent(p), size)
        axes.append(-half + size * np.arange(math.floor(2 * half / size + 0.5 - 1e-9) + 1))
    x, y, z = np.meshgrid(*axes, indexing="ij")
    out = shape.profile(np.sqrt(x**2 + y**2 + z**2), p)
    if zero_mean:
        out = out - out.mean()
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def voxels(points: DataFrame, pixel: float, z_pixel: float) -> tuple[DataFrame, list[float], list[int]]:
    """``(i_x, i_y, i_z, n)`` of occupied voxels, the least coordinates and the numbers of voxels; a largest value on an edge is in the last voxel."""
    finite = points.select(*(F.col(a).cast("double").alias(a) for a in "xyz"))
    for a in "xyz":
        finite = finite.where(F.abs(a) < float("inf"))
    row = finite.agg(*(f(a) for a in "xyz" for f in (F.min, F.max)), F.count(F.lit(1))).first()
    low = [row[2 * k] for k in range(3)]
    if row[-1] < 3:
        low = [0.0] * 3
        finite, count = finite.where("false"), [0] * 3
    else:
        count = [max(1, math.ceil((row[2 * k + 1] - low[k]) / s - 1e-9)) for k, s in enumerate((pixel, pixel, z_pixel))]
    index = [F.least(F.floor((F.col(a) - low[k]) / s), F.lit(count[k] - 1)).cast("long").alias(f"i_{a}") for k, (a, s) in enumerate(zip("xyz", (pixel, pixel, z_pixel), strict=True))]
    return finite.groupBy(*index).agg(F.count(F.lit(1)).alias("n")), low, count


def convolved(block: np.ndarray, k: np.ndarray) -> np.ndarray:
    """block with k, as large as block; k's middle is its voxel (size - 1) // 2."""
    shape = [a + b - 1 for a, b in zip(block.shape, k.shape, strict=True)]
    full = np.fft.irfftn(np.fft.rfftn(block, shape, axes=(0, 1, 2)) * np.fft.rfftn(k, shape, axes=(0, 1, 2)), shape, axes=(0, 1, 2))
    return full[tuple(slice((b - 1) // 2, (b - 1) // 2 + a) for a, b in zip(block.shape, k.shape, strict=True))]


def smoothed(block: np.ndarray, sigmas) -> np.ndarray:
    """Separable Gaussian, cut at four sigma; what lies beyond the block counts as zero."""
    for axis, sigma in enumerate(sigmas):
        reach = int(4 * sigma + 0.5)
        g = np.exp(-((np.arange(-reach, reach + 1) / sigma) ** 2) / 2)
        shape = [1, 1, 1]
        shape[axis] = len(g)
        block = convolved(block, (g / g.sum()).reshape(shape))
    return block


def band_widths(size: float, pixel: float, z_pixel: float) -> tuple[list[float], list[float]]:
    """The two Gaussian widths, in voxels of each axis, of the band-pass at a structure's scale."""
    radius = [size / 2 / s for s in (pixel, pixel, z_pixel)]
    return [max(0.7 * x, 1.0) for x in radius], [max(2.0 * x, 2.0) for x in radius]


def band_pass(block: np.ndarray, first: np.ndarray, count: np.ndarray, narrow, wide) -> np.ndarray:
    """Difference of two Gaussians; beyond the volume's border the response is mirrored. first: the block's first voxel."""
    for axis in range(3):
        at = np.arange(first[axis], first[axis] + block.shape[axis])
        period = 2 * count[axis]
        at = np.mod(at, period)
        at = np.minimum(at, period - 1 - at) - first[axis]
        inside = (at >= 0) & (at < block.shape[axis])
        block = np.take(block, np.where(inside, at, 0), axis=axis)
        shape = [1, 1, 1]
        shape[axis] = len(at)
        block = block * inside.reshape(shape)
    return smoothed(block, narrow) - smoothed(block, wide)


def local_maxima(block: np.ndarray) -> np.ndarray:
    """Where a voxel, not on the block's border, is at least its 26 neighbours and above zero."""
    best = block
    for axis in range(3):
        n = block.shape[axis]
        best = np.maximum(np.maximum(np.take(best, range(0, n - 2), axis), np.take(best, range(1, n - 1), axis)), np.take(best, range(2, n), axis))
    out = np.zeros(block.shape, bool)
    core = block[1:-1, 1:-1, 1:-1]
    out[1:-1, 1:-1, 1:-1] = (core >= best) & (core > 0)
    return out


def responses(cells: DataFrame, count: list[int], k: np.ndarray, sqrt: bool, band: tuple | None, side: int) -> DataFrame:
    """``(i_x, i_y, i_z, response)`` of local maxima."""
    reach = [max((n - 1) // 2, n // 2) for n in k.shape]
    if band:
        reach = [a + int(4 * w + 0.5) for a, w in zip(reach, band[1], strict=True)]
    margin = [a + 1 for a in reach]
    limits = np.array(count)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = np.array([pdf[f"t_{a}"].iloc[0] for a in "xyz"])
        first = tile * side - margin
        block = np.zeros([side + 2 * m for m in margin])
        block[tuple(pdf[f"i_{a}"].to_numpy() - first[i] for i, a in enumerate("xyz"))] = np.sqrt(pdf["n"]) if sqrt else pdf["n"]
        r = convolved(block, k)
        if band:
            r = band_pass(r, first, limits, *band)
        for axis in range(3):  # nothing beyond the volume is a neighbour
            at = first[axis] + np.arange(r.shape[axis])
            shape = [1, 1, 1]
            shape[axis] = len(at)
            r = np.where(((at >= 0) & (at < limits[axis])).reshape(shape), r, -np.inf)
        at = np.argwhere(local_maxima(r)) + first
        at = at[((at >= tile * side) & (at < (tile + 1) * side)).all(1)]
        got = {f"i_{a}": at[:, i] for i, a in enumerate("xyz")}
        return pd.DataFrame(got | {"response": r[tuple((at - first).T)]})

    dealt = cells
    for i, a in enumerate("xyz"):
        lo, hi = F.floor((F.col(f"i_{a}") - margin[i]) / side), F.floor((F.col(f"i_{a}") + margin[i]) / side)
        dealt = dealt.withColumn(f"t_{a}", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(max(count[i] - 1, 0) // side)))))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [f"t_{a}" for a in "xyz"]
    return dealt.repartition(parts, *at).groupBy(*at).applyInPandas(find, "i_x long, i_y long, i_z long, response double")


def detections(
    points: DataFrame,
    name: str,
    params: dict | None = None,
    pixel: float = 8.0,
    z_pixel: float = 16.0,
    min_response: float = 0.3,
    distance: float | None = None,
    zero_mean: bool = True,
    sqrt: bool = False,
    band_pass: bool = False,
    most: int | None = None,
    side: int = 64,
) -> DataFrame:
    """``(id, x, y, z, score)``: centres of places like the model, by responses as shares of the largest one.

    Of two within ``distance`` (the model's size if None) the stronger stays; of equal ones the first by x, y and z.
    Fewer than three finite points give none; ``most`` keeps the strongest.
    """
    shape, p = model(name, params)
    size = shape.size(p)
    cells, low, count = voxels(points, pixel, z_pixel)
    found = stored(responses(cells, count, kernel(name, params, pixel, z_pixel, zero_mean), sqrt, band_widths(size, pixel, z_pixel) if band_pass else None, side), "responses")
    largest = found.agg(F.max("response")).first()[0] or 1.0
    centre = [(F.lit(low[i]) + (F.col(f"i_{a}") + 0.5) * s).alias(a) for i, (a, s) in enumerate(zip("xyz", (pixel, pixel, z_pixel), strict=True))]
    index = ((F.col("i_x") * count[1] + F.col("i_y")) * count[2] + F.col("i_z")).alias("id")
    peaks = found.select(index, *centre, (F.col("response") / largest).alias("score")).where(F.col("score") >= min_response)
    reach = size if distance is None else distance
    kept = stored(apart(peaks, reach, ("x", "y", "z")) if reach > 0 else peaks, "detections")
    release(found)
    return kept.orderBy(F.desc("score"), "id").limit(most) if most is not None else kept


def voxel_count(points: DataFrame, pixel: float, z_pixel: float) -> int:
    """Voxels of the points' box, with one more at each axis' end for safety."""
    row = points.agg(*((F.max(a) - F.min(a)).cast("double") for a in "xyz")).first()
    return 0 if row[0] is None else math.prod(int(v / s) + 2 for v, s in zip(row, (pixel, pixel, z_pixel), strict=True))


def voxel_sizes(points: DataFrame, most: int = 8_000_000, z_ratio: float = 2.0, step: float = 1.0, least: float = 1.0) -> tuple[float, float]:
    """The smallest voxel, a multiple of ``step`` in the plane and ``z_ratio`` times that in z, with at most ``most`` voxels. One aggregate."""
    row = points.agg(*((F.max(a) - F.min(a)).cast("double") for a in "xyz")).first()
    if row[0] is None:
        return least, least * z_ratio
    pixel = max(least, math.ceil(max((max(math.prod(row), 0) / (z_ratio * most)) ** (1 / 3), least) / step) * step)
    while math.prod(int(v / s) + 2 for v, s in zip(row, (pixel, pixel, z_ratio * pixel), strict=True)) > most:
        pixel += step
    return pixel, z_ratio * pixel
