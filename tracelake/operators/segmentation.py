"""Structures in rasters: template detection, ridges and skeletons, on tiles with a margin.

Spark rasters the points and deals occupied pixels to tiles; a pixel near an edge
goes to the neighbouring tiles as well, so a tile's task sees all it needs, and
a response counts only in its own tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.histogram import raster
from tracelake.operators.spatial import apart, ring_counts, ring_support


def kernel(shape: str, radius: float, width: float) -> np.ndarray:
    """A zero-mean kernel of unit norm: ``ring``, ``disk``, ``gaussian`` or ``log``, sizes in pixels."""
    half = int(np.ceil(radius + 3 * width))
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    d = np.hypot(x, y)
    k = {
        "ring": lambda: np.exp(-(((d - radius) / width) ** 2) / 2),
        "disk": lambda: 1 / (1 + np.exp((d - radius) / max(width, 1e-6))),
        "gaussian": lambda: np.exp(-((d / radius) ** 2) / 2),
        "log": lambda: (1 - (d / radius) ** 2 / 2) * np.exp(-((d / radius) ** 2) / 2),
    }
    if shape not in k:
        raise ValueError(f"no kernel {shape!r}; there are {', '.join(k)}")
    out = k[shape]()
    out = out - out.mean()
    return out / np.linalg.norm(out)


def smoothed(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with mirrored edges."""
    if sigma <= 0:
        return image
    r = min(int(np.ceil(4 * sigma)), min(image.shape) - 1)
    g = np.exp(-((np.arange(-r, r + 1) / sigma) ** 2) / 2)
    g /= g.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        image = sum(w * np.take(padded, range(i, i + image.shape[axis]), axis=axis) for i, w in enumerate(g))
    return image


def convolved(image: np.ndarray, k: np.ndarray) -> np.ndarray:
    shape = [a + b - 1 for a, b in zip(image.shape, k.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(k[::-1, ::-1], shape), shape)
    y, x = k.shape[0] // 2, k.shape[1] // 2
    return full[y : y + image.shape[0], x : x + image.shape[1]]


def tiled(pixels: DataFrame, side: int, margin: int, function, schema: str) -> DataFrame:
    """``function(image, x0, y0)`` of each tile with its margin: rows for pixels of the tile itself. pixels: (i_x, i_y, n)."""

    def around(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - margin) / side), F.floor((F.col(c) + margin) / side))

    dealt = pixels.withColumn("t_x", F.explode(around("i_x"))).withColumn("t_y", F.explode(around("i_y")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["t_x"].iloc[0]) * side - margin, int(pdf["t_y"].iloc[0]) * side - margin
        image = np.zeros((side + 2 * margin, side + 2 * margin))
        image[pdf["i_y"].to_numpy() - y0, pdf["i_x"].to_numpy() - x0] = pdf["n"].to_numpy()
        return function(image, x0, y0)

    return dealt.groupBy("t_x", "t_y").applyInPandas(run, schema)


def local_peaks(image: np.ndarray, margin: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of strict 3x3 maxima above a threshold, outside the margin; of equal neighbours the first counts."""
    c = image[1:-1, 1:-1]
    best = c > threshold
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                n = image[1 + dy : image.shape[0] - 1 + dy, 1 + dx : image.shape[1] - 1 + dx]
                best &= (c > n) if (dy, dx) < (0, 0) else (c >= n)
    y, x = np.nonzero(best)
    y, x = y + 1, x + 1
    keep = (y >= margin) & (y < image.shape[0] - margin) & (x >= margin) & (x < image.shape[1] - margin)
    return y[keep], x[keep]


def detections(points: DataFrame, pixel: float, shape: str, radius: float, width: float, threshold: float, side: int = 256, most: int | None = None) -> DataFrame:
    """``(id, x, y, score)``: template matches at least a radius apart, the strongest first where ``most`` is given."""
    k = kernel(shape, radius / pixel, width / pixel)
    margin = k.shape[0] // 2 + 2

    def find(image: np.ndarray, x0: int, y0: int) -> pd.DataFrame:
        r = convolved(np.sqrt(image), k)
        y, x = local_peaks(r, margin, threshold)
        return pd.DataFrame({"i_x": x + x0, "i_y": y + y0, "score": r[y, x]})

    found = tiled(raster(points, pixel), max(side, margin), margin, find, "i_x long, i_y long, score double")
    peaks = found.select(F.xxhash64("i_x", "i_y").alias("id"), ((F.col("i_x") + 0.5) * pixel).alias("x"), ((F.col("i_y") + 0.5) * pixel).alias("y"), "score")
    kept = apart(peaks, radius)
    return kept.orderBy(F.desc("score"), "id").limit(most) if most else kept


def validated(found: DataFrame, points: DataFrame, radius: float, width: float, min_coverage: float = 0.5, max_hole: float = 0.5) -> DataFrame:
    """Detections whose ring is covered all around and whose hole is emptier than the ring."""
    lo, hi = radius - width, radius + width
    counts = ring_counts(found, points, lo, hi, hi + width)
    support = ring_support(found, points, lo, hi)
    ok = (F.col("coverage") >= min_coverage) & (F.col("n_hole") <= max_hole * F.greatest(F.col("n_ring"), F.lit(1)))
    return found.join(counts, "id").join(support, "id").where(ok)


def ridge(image: np.ndarray, sigmas) -> np.ndarray:
    """Largest scale-normalized response to bright lines: minus the smaller eigenvalue of the Hessian, where that is larger in size."""
    best = np.zeros_like(image)
    for s in sigmas:
        g = smoothed(image, s)
        gy, gx = np.gradient(g)
        gyy, gyx = np.gradient(gy)
        _, gxx = np.gradient(gx)
        mid, off = (gxx + gyy) / 2, np.sqrt(((gxx - gyy) / 2) ** 2 + gyx**2)
        low, high = mid - off, mid + off
        best = np.maximum(best, np.where(-low > np.abs(high), -low, 0) * s * s)
    return best


#: Neighbours as bits of a code, clockwise from the one above: (row step, column step).
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def deletable() -> np.ndarray:
    """For each of two passes and each neighbour code: may the pixel go?

    It may if its 2 to 6 neighbours form one run around it, and the sides that the
    pass peels, south and east or north and west, are open.
    """
    code = np.arange(256, dtype=np.uint8)
    runs = np.bitwise_count(code & ~((code << 1) | (code >> 7)))
    size = np.bitwise_count(code)
    simple = (runs == 1) & (size >= 2) & (size <= 6)
    north, east, south, west = (1 << k for k in (0, 2, 4, 6))

    def open_side(*sides: int) -> np.ndarray:
        wall = np.uint8(sum(sides))
        return (code & wall) != wall

    return np.stack([simple & open_side(north, east, south) & open_side(east, south, west), simple & open_side(north, east, west) & open_side(north, south, west)])


def thinned(mask: np.ndarray) -> np.ndarray:
    """Skeleton by alternating passes that look up each pixel's neighbour code in a table of deletable ones."""
    table, m = deletable(), np.pad(mask.astype(np.uint8), 1)
    rows, cols = mask.shape
    idle = 0
    while idle < 2:
        for peel in table:
            code = sum((m[1 + dy : 1 + dy + rows, 1 + dx : 1 + dx + cols] << k for k, (dy, dx) in enumerate(AROUND)), np.zeros(mask.shape, dtype=np.uint8))
            gone = peel[code] & (m[1:-1, 1:-1] == 1)
            m[1:-1, 1:-1][gone] = 0
            idle = 0 if gone.any() else idle + 1
    return m[1:-1, 1:-1].astype(bool)


def skeleton(points: DataFrame, pixel: float, sigmas=(1.5, 2.5), threshold: float = 0.1, side: int = 256, margin: int = 24) -> DataFrame:
    """``(i_x, i_y)``: centre lines of bright ridges."""

    def find(image: np.ndarray, x0: int, y0: int) -> pd.DataFrame:
        s = thinned(ridge(np.sqrt(image), sigmas) > threshold)[margin:-margin, margin:-margin]
        y, x = np.nonzero(s)
        return pd.DataFrame({"i_x": x + x0 + margin, "i_y": y + y0 + margin})

    return tiled(raster(points, pixel), side, margin, find, "i_x long, i_y long")


def profile_across(image: DataFrame, vertices, pixel: float, half_width: int) -> DataFrame:
    """``(offset, v)``: mean pixel value at each offset across a path, over all its vertices. image: (ix, iy, value)."""
    from tracelake.operators.spatial import sample_image

    rows = []
    for k, ((ax, ay), (bx, by)) in enumerate(zip(vertices, vertices[1:], strict=False)):
        length = np.hypot(bx - ax, by - ay)
        if length:
            nx, ny = -(by - ay) / length, (bx - ax) / length
            rows += [(k * 1000 + o + half_width, float(o), ax + nx * o * pixel, ay + ny * o * pixel) for o in range(-half_width, half_width + 1)]
    at = image.sparkSession.createDataFrame([(int(i), o, float(x), float(y)) for i, o, x, y in rows], "id long, offset double, x double, y double")
    return sample_image(at, image, pixel, "bilinear").groupBy("offset").agg(F.avg("signal").alias("v"))
