"""Work on all neighbours of points without a table of pairs.

Points are dealt to square tiles, with a copy in every tile that lies within
the radius; a task takes a tile's own points against all that it was dealt, and
returns what is asked of the pairs: counts, nearest distances, a forest of
links.  Within a tile, points meet by the cells of one grid over all tiles, in
blocks of bounded size.  Cells and tiles are as large as the crowding allows, so
the copies stay few; a tile still too full is cut into parts, own points by
points around, whose results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROWD = 32  # points of a cell, as a point sees it
FULL = 16_384  # own points of a tile; those around are at most 9 (in space: 27) times as many
WIDE = 1 << 17  # and where points are so many that tiles are enough for all tasks
TILES = 64
FINE = 8  # cells of a radius, at most, where points are gathered by finer cells
BLOCK = 1 << 20  # distances at once
LEVELS = 12


@dataclass(frozen=True)
class Grid:
    radius: float
    cell: float
    tile: float
    axes: tuple[str, ...]
    crowded: bool  # some tile has more than ``full`` points
    shift: float = 0.0  # of the tiles
    full: int = FULL
    fine: int = 1  # finer cells of a radius

    def tiles(self) -> list[Column]:
        return [F.floor((F.col(a) + self.shift) / self.tile).alias(f"t_{a}") for a in self.axes]


def finite(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    for a in axes:
        points = points.where(F.abs(a) < float("inf"))  # NaN is larger
    return points


def crowding(points: DataFrame, size: float, axes: Sequence[str], by: Sequence[str] = ()) -> list[tuple[float, int]]:
    """For cells of ``size`` times 1, 2, 4, ..: points of a cell as a point sees it on average, and at most."""
    return _crowding(points, size, axes, by)[0]


def _crowding(points: DataFrame, size: float, axes: Sequence[str], by: Sequence[str]) -> tuple[list[tuple[float, int]], int]:
    """That, and how many points there are."""
    cells = points.groupBy(*by, *(F.floor(F.col(a) / size).alias(f"c_{a}") for a in axes)).agg(F.count(F.lit(1)).alias("n"))
    each = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    up = [F.expr(f"shiftright(c_{a}, level)").alias(f"c_{a}") for a in axes]
    sums = each.select(*by, "level", *up, "n").groupBy(*by, "level", *(f"c_{a}" for a in axes)).agg(F.sum("n").alias("n"))
    seen = F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")
    rows = {r.level: r for r in sums.groupBy("level").agg(seen.alias("seen"), F.max("n").alias("most"), F.sum("n").alias("n")).collect()}
    return [(rows[k].seen, rows[k].most) if k in rows else (0.0, 0) for k in range(LEVELS)], rows[0].n if rows else 0


def grid_of(points: DataFrame, radius: float, axes: Sequence[str] = ("x", "y"), by: Sequence[str] = ()) -> Grid:
    found, n = _crowding(points, radius, axes, by)
    full = max(FULL, min(WIDE, n // TILES))
    cell = next((k for k, (seen, _) in enumerate(found) if seen >= CROWD), LEVELS - 1)
    while cell and found[cell][1] > full:
        cell -= 1
    tile = cell
    while tile + 1 < LEVELS and tile < cell + 4 and found[tile + 1][1] <= full:
        tile += 1
    wide = radius * (1 + 1e-9)  # a distance of exactly the radius never skips a cell
    fine = min(FINE, max(1, int((found[0][0] / CROWD) ** (1 / len(axes)))))
    return Grid(radius, wide * 2**cell, wide * 2**tile, tuple(axes), found[tile][1] > full, full=full, fine=fine)


def around(points: DataFrame, grid: Grid) -> DataFrame:
    """A copy for every tile within the radius, and a little beyond because of rounding."""
    for a in grid.axes:
        reach = F.lit(grid.radius * (1 + 1e-6)) + F.abs(a) * 1e-12
        first, last = (F.floor((F.col(a) + grid.shift + s * reach) / grid.tile) for s in (-1, 1))
        points = points.withColumn(f"t_{a}", F.explode(F.sequence(first, last)))
    return points


def by_tile(left: DataFrame, right: DataFrame, grid: Grid, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by: Sequence[str] = (), cut: bool = True) -> DataFrame:
    """What ``work`` returns for each tile, or each part of a full one, from its own rows (of left) and those around (of right).

    Both have the same columns. Without ``cut`` the points around are never divided, so that one part sees all of them.
    """
    tiles = [f"t_{a}" for a in grid.axes]
    keys = [*by, *tiles]
    names = left.columns
    if left is right and not grid.crowded:  # a tile's own points are among those dealt to it
        mine = F.lit(True)
        for a, t in zip(grid.axes, grid.tiles(), strict=True):
            mine = mine & (F.col(f"t_{a}") == t)
        return _grouped(around(left, grid).withColumn("own__", mine), keys, lambda table: work(table.filter(table["own__"]), table), schema)
    own, near = left.select("*", *grid.tiles()), around(right.select(*names), grid)
    if left is not right:
        near = near.join(own.select(*keys).distinct(), keys, "left_semi")
    if grid.crowded:  # few tiles
        parts = lambda df, name, most: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias(name))
        dealt = lambda name: F.pmod(F.xxhash64(*names), F.coalesce(name, F.lit(1)).cast("long")).cast("int")
        every = lambda name: F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1))
        full = parts(own, "a_parts", grid.full).join(parts(near, "b_parts", 4 * grid.full if cut else 1 << 62), keys, "full")
        full = F.broadcast(full)
        own = own.join(full, keys, "left").withColumn("a_part", dealt("a_parts")).withColumn("b_part", every("b_parts"))
        near = near.join(full, keys, "left").withColumn("b_part", dealt("b_parts")).withColumn("a_part", every("a_parts"))
        keys = [*keys, "a_part", "b_part"]
    rows = own.select(*names, *keys[len(by) :], F.lit(True).alias("own__")).unionByName(near.select(*names, *keys[len(by) :], F.lit(False).alias("own__")))

    def run(table: pa.Table) -> pa.Table:
        mine = table["own__"]
        return work(table.filter(mine), table.filter(pa.compute.invert(mine)))

    return _grouped(rows, keys, run, schema)


def _grouped(rows: DataFrame, keys: Sequence[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, TILES), *keys).groupBy(*keys).applyInArrow(run, schema)


def places(table: pa.Table, axes: Sequence[str]) -> np.ndarray:
    return np.stack([table[a].to_numpy().astype(float) for a in axes], 1) if table.num_rows else np.zeros((0, len(axes)))


def meetings(a: np.ndarray, b: np.ndarray, grid: Grid, half: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Blocks ``(i, j, d2, same)``: rows of a, rows of b (those of the same cell first, ``same`` of them, if half) and their squared distances.

    Each a meets all of b within the radius; with ``half``, of two cells only the first meets the other, and a cell itself.
    """
    if not len(a) or not len(b):
        return
    d = a.shape[1]
    ca, cb = np.floor(a / grid.cell).astype(np.int64), np.floor(b / grid.cell).astype(np.int64)
    low = np.minimum(ca.min(0), cb.min(0)) - 1
    spans = np.maximum(ca.max(0), cb.max(0)) - low + 2
    scale = np.array([int(np.prod(spans[k + 1 :])) for k in range(d)], dtype=np.int64)
    ka, kb = ((c - low) @ scale for c in (ca, cb))
    order_a, order_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, kb = ka[order_a], kb[order_b]
    starts = np.flatnonzero(np.append(True, ka[1:] != ka[:-1]))
    ends = np.append(starts[1:], len(ka))
    runs = [(int(np.dot(p, scale[:-1])), -1) for p in product((-1, 0, 1), repeat=d - 1)]
    if half:
        runs = [(0, 0)] + [(o, -1) for o, _ in runs if o > 0]
    at = ka[starts]
    lo = [np.searchsorted(kb, at + o + first) for o, first in runs]
    hi = [np.searchsorted(kb, at + o + 1, "right") for o, _ in runs]
    inner = np.searchsorted(kb, at, "right") - lo[0] if half else np.zeros(len(at), np.int64)
    for c, (s, e) in enumerate(zip(starts, ends, strict=True)):
        j = np.concatenate([order_b[p[c] : q[c]] for p, q in zip(lo, hi, strict=True)])
        if not len(j):
            continue
        wide = min(len(j), BLOCK) if half else len(j)
        step = max(1, BLOCK // wide)
        for k in range(s, e, step):
            i = order_a[k : min(e, k + step)]
            for m in range(0, len(j), wide):
                jj = j[m : m + wide]
                d2 = np.zeros((len(i), len(jj)))
                for axis in range(d):
                    gap = a[i, axis][:, None] - b[jj, axis][None]
                    gap *= gap
                    d2 += gap
                yield i, jj, d2, max(0, int(inner[c]) - m)


def gathered(a: np.ndarray, b: np.ndarray, grid: Grid, half: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(i, j, same)`` by the finer cells of the grid: rows of a in one cell, and all of b that may lie within the radius of any.

    With ``half``, of two cells only the first meets the other; then the rows of the same cell come first, ``same`` of them.
    """
    if not len(a) or not len(b):
        return
    d, n = a.shape[1], grid.fine
    side = grid.cell if n == 1 else grid.radius * (1 + 1e-9) / n  # a distance of exactly the radius never skips a cell
    ca, cb = np.floor(a / side).astype(np.int64), np.floor(b / side).astype(np.int64)
    low = np.minimum(ca.min(0), cb.min(0)) - n
    spans = np.maximum(ca.max(0), cb.max(0)) - low + n + 1
    scale = np.array([int(np.prod(spans[k + 1 :])) for k in range(d)], dtype=np.int64)
    ka, kb = ((c - low) @ scale for c in (ca, cb))
    order_a, order_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, kb = ka[order_a], kb[order_b]
    starts = np.flatnonzero(np.append(True, ka[1:] != ka[:-1]))
    ends = np.append(starts[1:], len(ka))
    runs = []
    for p in product(range(-n, n + 1), repeat=d - 1):
        room = n * n - sum(max(0, abs(o) - 1) ** 2 for o in p)
        if room >= 0:
            runs.append((int(np.dot(p, scale[:-1])), min(n, math.isqrt(room) + 1)))
    if half:
        runs = [(o, r) for o, r in runs if o > 0]
    at = ka[starts]
    edges = [(np.searchsorted(kb, at), np.searchsorted(kb, at, "right")), (np.searchsorted(kb, at, "right"), np.searchsorted(kb, at + n, "right"))] if half else []
    edges += [(np.searchsorted(kb, at + o - r), np.searchsorted(kb, at + o + r, "right")) for o, r in runs]
    for c, (s, e) in enumerate(zip(starts, ends, strict=True)):
        j = np.concatenate([order_b[p[c] : q[c]] for p, q in edges])
        if len(j):
            yield order_a[s:e], j, int(edges[0][1][c] - edges[0][0][c]) if half else 0


def measured(a: np.ndarray, b: np.ndarray, block: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Squared distances of a and b (each with a row an axis), as products of matrices in the place of ``block``: quick, but not to the last digits. Both should lie around zero."""
    d, n = a.shape
    left, right = np.empty((d + 2, n), block.dtype), np.empty((d + 2, b.shape[1]), block.dtype)
    left[:d], left[d], left[d + 1] = a * -2, sum(x * x for x in a), 1.0
    right[:d], right[d], right[d + 1] = b, 1.0, sum(x * x for x in b)
    left = np.ascontiguousarray(left.T)
    wide = max(1, min(right.shape[1], len(block)))
    step = max(1, len(block) // wide)
    for k in range(0, n, step):
        for m in range(0, right.shape[1], wide):
            rows, columns = left[k : k + step], right[:, m : m + wide]
            yield slice(k, k + step), slice(m, m + wide), np.matmul(rows, columns, out=block[: len(rows) * columns.shape[1]].reshape(len(rows), -1))


def once(d2: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: int) -> np.ndarray:
    """Blocks of half meetings: pairs within a cell count in the order of their ids."""
    if same:
        d2[:, :same][ids_a[:, None] >= ids_b[None, :same]] = np.inf
    return d2


def merged_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j; a label is the smallest index of its set."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label
