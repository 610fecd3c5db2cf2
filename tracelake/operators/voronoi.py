"""Voronoi cells and nearest seeds, in the plane and in space.

``cells`` gives the area or volume of each distinct position's cell.  Positions
meet in square tiles; a task has a tile's positions and those of the tiles
around it.  A cell is found without a triangulation: each bisector of two
positions carries a face of the cell where the other bisectors leave a piece of
it, so faces are intervals (in space: sums over intervals) that all other
bisectors cut.  The search begins with the nearest positions and adds any that
lies nearer to a corner of the cell than its own position, until none does.

A cell is final if the balls around its corners, through its own position,
have no room for unseen positions: these lie beyond the tiles seen and inside the
box of all positions, so cells on the edge of a set can be final at once.  The
others go on, with the neighbours found so far, to tiles four times as large.  Two positions that share a face but haven't met are both still
open, so a round needs the open positions only; these become few quickly.
Positions in nearly empty tiles wait for larger ones, and are told of the
finished cells that they border on.

``nearest_seed`` looks positions up in a pyramid of tiles: from the coarsest
level down, a query keeps the tiles whose box may hold its nearest seed.

Positions with a coordinate that isn't finite are left out.  Cells without a
bound have a null size; in a set on one line (in space: one plane) all have.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.storage import release, stored

FIRST = {2: 12, 3: 24}  # neighbours that a cell begins with
SIDES = {2: 2.0, 3: 1.0}  # of the first tiles, by the side of TILE positions: those in the plane see little around them
MARGIN = {2: 0.25, 3: 1.0}  # sides of a tile that its task sees around it
TOGETHER = 256  # cells in the plane at once
SPOT = 48  # positions of a tile in the plane that are looked at together, and nearest ones that each meets at first
ROUNDS = 8  # of neighbours from among these
BESIDE = 1e-9  # a corner counts as nearer to another position beyond this share of its distance
FAR = 1e5  # corners farther than this many extents count as none
TILE = 128  # positions of a tile on average
CROWD = 1024  # and at most
FEW = 8  # a tile with fewer positions isn't worth a look yet
ROWS = 64  # cells that a task computes at once
SLACK = 1e-9  # sides of a tile that positions are dealt beyond its margin
TABLE = 1 << 18  # and neighbours, to the power of the dimensions, of them together


def positions(points: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Distinct finite positions with ``n``, how many points each has."""
    finite = points.select(*(F.col(a).cast("double").alias(a) for a in axes))
    for a in axes:
        finite = finite.where(F.abs(a) < float("inf")).withColumn(a, F.col(a) + F.lit(0.0))  # no negative zero
    return finite.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))


def _bounds(sites: DataFrame, axes: Sequence[str]) -> tuple[list[float], list[float], int]:
    row = sites.agg(*(f(a) for a in axes for f in (F.min, F.max)), F.count(F.lit(1))).first()
    return [row[2 * i] for i in range(len(axes))], [row[2 * i + 1] for i in range(len(axes))], row[-1]


def _tile_size(sites: DataFrame, axes: Sequence[str], low: Sequence[float], high: Sequence[float], n: int) -> float:
    """A side with ``TILE`` positions a tile on average and ``CROWD`` at most; the counts are added up in the map tasks."""
    sides = [h - v for v, h in zip(low, high, strict=True) if h > v] or [1.0]
    size = (math.prod(sides) * TILE / max(n, 1)) ** (1 / len(sides))
    while True:
        tile = [F.floor((F.col(a) - v) / size).alias(f"t_{a}") for a, v in zip(axes, low, strict=True)]
        most = sites.groupBy(*tile).count().agg(F.max("count")).first()[0] or 0
        if most <= CROWD or size < 1e-12 * max(sides):
            return size
        size /= 2


def faces(site: np.ndarray, others: np.ndarray, valid: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of ``site`` (n, d) among ``others`` (n, k, d): which others bear a face, the sizes (infinite without a bound), the corners (n, c, d), NaN where there is none."""
    n, k, d = others.shape
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        to = np.where(valid[..., None], others - site[:, None], np.nan)  # the cell is where to . x <= |to|^2 / 2
        half = (to**2).sum(-1) / 2
        length = np.sqrt(2 * half)
        unit = to / length[..., None]
        if d == 2:
            along = np.stack([-unit[..., 1], unit[..., 0]], -1)
            lo, hi = _cut(to / 2, along, to, half, np.arange(k)[None, :, None], far)
            got = np.where(hi > lo, hi - lo, 0.0)
            corners = np.concatenate([to / 2 + lo[..., None] * along, to / 2 + hi[..., None] * along], 1)
            corners[np.tile(got, (1, 2)) <= 0] = np.nan
            size = np.where(got > 0, got * length, 0.0).sum(1) / 4
            return got > 0, _bounded(size, corners, far), corners + site[:, None]
        # the line that two bisector planes share, seen from the middle of the first
        other = unit[:, None, :, :]
        cos = (unit[:, :, None, :] * other).sum(-1)
        inward = other - cos[..., None] * unit[:, :, None, :]  # in the first plane, across the line
        scale = np.sqrt(np.maximum(1 - cos**2, 0))
        across = inward / np.where(scale > 1e-6, scale, np.nan)[..., None]
        reach = (half[:, None, :] / length[:, None, :] - (to[:, :, None, :] / 2 * other).sum(-1)) / scale  # signed distance of the line from the middle
        start = to[:, :, None, :] / 2 + reach[..., None] * across
        along = np.cross(unit[:, :, None, :], across)
        i = np.arange(k)
        pairs = (start.reshape(n, k * k, 3), along.reshape(n, k * k, 3))
        lo, hi = _cut(*pairs, to, half, np.stack([np.repeat(i, k), np.tile(i, k)], -1)[None], far)
        got = np.where(hi > lo, hi - lo, 0.0)
        corners = np.concatenate([pairs[0] + lo[..., None] * pairs[1], pairs[0] + hi[..., None] * pairs[1]], 1)
        corners[np.tile(got, (1, 2)) <= 0] = np.nan
        area = np.nansum(np.where(got.reshape(n, k, k) > 0, got.reshape(n, k, k) * reach, 0.0), 2) / 2
        size = np.nansum(np.where(area > 0, area * length, 0.0), 1) / 6
        return (got.reshape(n, k, k) > 0).any(2), _bounded(size, corners, far), corners + site[:, None]


def _bounded(size: np.ndarray, corners: np.ndarray, far: float) -> np.ndarray:
    reach = np.nanmax(np.where(np.isnan(corners), 0.0, np.abs(corners)), axis=(1, 2)) if corners.size else np.zeros(len(size))
    return np.where((reach >= far * 0.5) | (size <= 0), np.inf, size)


def _cut(start: np.ndarray, along: np.ndarray, to: np.ndarray, half: np.ndarray, own: np.ndarray, far: float):
    """The interval of each line start + t along (n, m, d) inside all half-spaces to . x <= half but its own ones (1, m, few)."""
    slope = np.einsum("nmd,nkd->nmk", along, to)
    room = half[:, None, :] - np.einsum("nmd,nkd->nmk", start, to)
    mine = np.zeros((1, slope.shape[1], slope.shape[2]), bool)
    np.put_along_axis(mine, own, True, 2)
    steep = np.abs(slope) > 1e-12 * np.sqrt(2 * half)[:, None, :]
    at = room / slope
    hi = np.nanmin(np.where(steep & (slope > 0) & ~mine, at, far), 2)
    lo = np.nanmax(np.where(steep & (slope < 0) & ~mine, at, -far), 2)
    # a line along another bisector: outside it, or the same line once more, which then counts for the first of the two
    again = (np.abs(room) <= 1e-9 * half[:, None, :]) & (np.arange(to.shape[1]) < own[..., -1:])
    outside = (~steep & ~mine & ((room < 0) | again) & ~np.isnan(room)).any(2) | np.isnan(start).any(2) | np.isnan(along).any(2)
    return np.where(outside, 0.0, lo), np.where(outside, 0.0, hi)


def cells_of(own: np.ndarray, block: np.ndarray, carried: list[np.ndarray], far: float, unseen: Sequence[tuple[np.ndarray, np.ndarray]] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sizes, whether they are final and the neighbours with a face, of the cells of ``own`` among ``block`` and each one's carried positions.

    A cell is final if no box of ``unseen`` (its least and largest corner) has room for a position nearer to a corner of the cell than its own.
    """
    n, d = own.shape
    size, final, near = np.full(n, np.inf), np.full(n, not len(unseen)), [np.zeros((0, d))] * n
    for lo in range(0, n, ROWS):
        site = own[lo : lo + ROWS]
        every = np.unique(np.concatenate([block, *[c for c in carried[lo : lo + ROWS] if len(c)]]), axis=0)
        k = min(FIRST[d], len(every) - 1)
        if k < 1:
            continue
        away = np.stack([((every - s) ** 2).sum(-1) for s in site])
        away[away == 0] = np.inf
        chosen = [set(row) for row in np.argpartition(away, k - 1, 1)[:, :k].tolist()]
        number = {tuple(p): j for j, p in enumerate(every.tolist())}
        for i, c in enumerate(carried[lo : lo + ROWS]):
            chosen[i] |= {number[tuple(p)] for p in c.tolist()}
        open_ = list(range(len(site)))
        while open_:
            still = []
            for some in _alike(open_, chosen, d):
                most = max(len(chosen[i]) for i in some)
                at = np.array([sorted(chosen[i]) + [-1] * (most - len(chosen[i])) for i in some])
                bears, sizes, corners = faces(site[some], every[at], at >= 0, far)
                for row, i in enumerate(some):
                    c = corners[row][~np.isnan(corners[row, :, 0])] - site[i]
                    mine = (c**2).sum(1)
                    # only what lies within twice the farthest corner can be nearer to a corner
                    within = np.flatnonzero(away[i] <= 4 * mine.max(initial=0.0) * (1 + BESIDE))
                    hit, to = set(), every[within] - site[i]
                    for part in range(0, len(c) if len(within) else 0, max(1, (1 << 20) // len(within))):
                        ends = slice(part, part + max(1, (1 << 20) // len(within)))
                        nearer = away[i, within] - 2 * (c[ends] @ to.T)  # squared distance to the corner, less the own position's
                        hit |= set(within[np.unique(nearer.argmin(1)[nearer.min(1) < -BESIDE * mine[ends]])].tolist())
                    hit -= chosen[i]
                    kept = {j for j, b in zip(at[row].tolist(), bears[row].tolist(), strict=True) if b and j >= 0}
                    if hit:
                        chosen[i] = kept | hit
                        still.append(i)
                    else:
                        size[lo + i], final[lo + i] = sizes[row], not len(unseen) or len(c) > 0 and not _room(c, site[i], unseen)
                        near[lo + i] = every[sorted(kept)]
            open_ = still
    return size, final, near


def plane_cells(own: np.ndarray, block: np.ndarray, carried: list[np.ndarray], far: float, unseen: Sequence[tuple[np.ndarray, np.ndarray]] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """As ``cells_of``, in the plane: many cells at once among the nearest positions of each, and the others by ``cells_of``."""
    n, met = len(own), []
    size, final, near, done = np.full(n, np.inf), np.zeros(n, bool), [np.zeros((0, 2))] * n, np.zeros(n, bool)

    def settle() -> None:
        if not met:
            return
        part, others, away, known = map(np.concatenate, zip(*met, strict=True))
        met.clear()
        done[part], size[part], final[part], found = _nearest_cells(own[part], others, away, known, far, unseen)
        for i, f in zip(part[done[part]].tolist(), found, strict=True):
            near[i] = f

    low, high = block.min(0), block.max(0)
    step = math.sqrt(max(float(np.prod(high - low)), 1e-300) * SPOT / max(len(block), 1))
    last = np.floor((high - low) / step).astype(np.int64) if np.prod(high - low) > 0 else None
    if last is not None and len(block) > SPOT and last.max() < 1 << 20:
        spot, all_spots = (np.floor((p - low) / step).astype(np.int64) for p in (own, block))
        key = all_spots[:, 0] * (last[1] + 3) + all_spots[:, 1]
        block_of = block[np.argsort(key, kind="stable")]
        key = np.sort(key)
        quick = np.flatnonzero(np.array([not len(c) for c in carried], bool))
        mine = spot[quick, 0] * (last[1] + 3) + spot[quick, 1]
        order = quick[np.argsort(mine, kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(np.sort(mine))) + 1):
            if not len(rows):
                continue
            x, y = spot[rows[0]]
            edges = [(np.searchsorted(key, u * (last[1] + 3) + max(y - 1, 0)), np.searchsorted(key, u * (last[1] + 3) + y + 1, "right")) for u in range(max(x - 1, 0), x + 2)]
            some = np.concatenate([block_of[a:b] for a, b in edges])
            if len(some) <= SPOT:
                continue
            at = np.array([x, y])
            # the block goes on beyond what is looked at, unless that is its edge
            least, most = np.where(at > 1, low + (at - 1) * step, -np.inf), np.where(at + 1 < last, low + (at + 2) * step, np.inf)
            for k in range(0, len(rows), TOGETHER):
                part = rows[k : k + TOGETHER]
                met.append((part, *_nearest(own[part], some, np.minimum(own[part] - least, most - own[part]).min(1))))
                if sum(len(m[0]) for m in met) >= TOGETHER:
                    settle()
        settle()
    rest = np.flatnonzero(~done)
    if len(rest):
        sizes, sure, found = cells_of(own[rest], block, [carried[i] for i in rest], far, unseen)
        size[rest], final[rest] = sizes, sure
        for i, f in zip(rest.tolist(), found, strict=True):
            near[i] = f
    return size, final, near


def _nearest(site: np.ndarray, some: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of positions that are all within the limit: each site's nearest, their squared distances, and up to which of these nothing is left out."""
    away = (some[:, 0] - site[:, :1]) ** 2 + (some[:, 1] - site[:, 1:]) ** 2
    away[away == 0] = np.inf
    at = np.argpartition(away, SPOT - 1, 1)[:, :SPOT]
    at = np.take_along_axis(at, np.take_along_axis(away, at, 1).argsort(1), 1)
    away = np.take_along_axis(away, at, 1)
    return some[at], away, np.minimum(away[:, -1], np.maximum(limit, 0) ** 2)


def _nearest_cells(site: np.ndarray, others: np.ndarray, away: np.ndarray, known: np.ndarray, far: float, unseen: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Cells of sites among the nearest positions of each: which could be told, sizes, whether they are final; neighbours of those that could."""
    n = len(site)
    to = np.where(np.isfinite(away)[..., None], others - site[:, None], 0.0)
    chosen = np.isfinite(away)
    chosen[:, FIRST[2] :] = False
    got, size, final, borders = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, bool), np.zeros((n, SPOT), bool)
    left = np.arange(n)
    for _ in range(ROUNDS):
        pick = np.argsort(~chosen[left], 1, kind="stable")[:, : chosen[left].sum(1).max()]
        valid = np.take_along_axis(chosen[left], pick, 1)
        bears, sizes, corners = faces(site[left], others[left[:, None], pick], valid, far)
        c = corners - site[left][:, None]
        real = ~np.isnan(c[..., 0])
        c[~real] = 0.0
        mine = (c * c).sum(-1)
        k = pick.shape[1]  # a corner of a closed cell is the lower end of one face and the upper end of another
        p, q = np.nonzero(real[:, :k])
        nearer = np.einsum("mk,m->mk", to[left, :, 0][p], c[p, q, 0] * -2)
        nearer += to[left, :, 1][p] * (c[p, q, 1] * -2)[:, None]
        nearer += away[left][p]
        first = np.zeros((len(left), 2 * k), np.int64)
        first[p, q] = nearer.argmin(1)
        closer = nearer[np.arange(len(p)), first[p, q]] < -BESIDE * mine[p, q]
        p, q = p[closer], q[closer]
        hit = np.zeros((len(left), SPOT), bool)
        hit[p, first[p, q]] = True
        hit &= ~chosen[left]
        kept = np.zeros((len(left), SPOT), bool)
        np.put_along_axis(kept, pick, bears & valid, 1)
        more = hit.any(1)
        told = ~more & real.any(1) & (4 * mine.max(1) * (1 + BESIDE) < known[left])
        room = np.zeros(len(left), bool)
        for low, high in unseen:
            nearest = np.clip(c, low - site[left][:, None], high - site[left][:, None])
            room |= (((nearest * (nearest - 2 * c)).sum(-1) < 0) & real).any(1)
        one = left[told]
        got[one], size[one], final[one], borders[one] = True, sizes[told], ~room[told], kept[told]
        chosen[left[more]] = (kept | hit)[more]
        left = left[more]
        if not len(left):
            break
    return got, size, final, [others[i][borders[i]] for i in np.flatnonzero(got)]


def _alike(rows: list[int], chosen: list[set], d: int) -> list[list[int]]:
    """Rows in lots of like numbers of neighbours, such that a lot's table of lines by bisectors stays small."""
    lots: list[list[int]] = []
    for i in sorted(rows, key=lambda i: len(chosen[i])):
        if lots and (len(lots[-1]) + 1) * len(chosen[i]) ** d <= TABLE:
            lots[-1].append(i)
        else:
            lots.append([i])
    return lots


def _room(corners: np.ndarray, site: np.ndarray, unseen: Sequence[tuple[np.ndarray, np.ndarray]]) -> bool:
    """Whether a box has a place nearer to a corner (given from the site) than the site."""
    for low, high in unseen:
        nearest = np.clip(corners, low - site, high - site)
        # as products, since squares of far corners would lose what lies near the site
        if ((nearest * (nearest - 2 * corners)).sum(1) < 0).any():
            return True
    return False


def _tile_cells(axes: list[str], side: float, low: list[float], high: list[float], far: float, least: int = 1):
    """A task's work: the cells of a tile's own positions among all that it was dealt; of final ones the neighbours that must be told of them."""
    margin = MARGIN[len(axes)]
    work = plane_cells if len(axes) == 2 else cells_of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy(bool)
        mine = pdf[own]
        if mine.empty:  # a tile around the edge
            return pd.DataFrame(columns=[*axes, "n", "size", "final", "near"])
        tile, xyz = np.array([pdf[f"t_{a}"].iloc[0] for a in axes], float), pdf[axes].to_numpy(float)
        # beyond what is seen around the tile, as far as the outermost positions, lies what hasn't been seen
        start, end = np.asarray(low), np.asarray(high)
        first, last = start + (tile - margin) * side, start + (tile + 1 + margin) * side
        unseen = []
        for k in range(len(axes)):
            if first[k] > start[k]:
                unseen.append((start, np.where(np.arange(len(axes)) == k, first, end)))
            if last[k] <= end[k]:
                unseen.append((np.where(np.arange(len(axes)) == k, last, start), end))
        out = mine[[*axes, "n"]].copy()
        sizes, final, found = work(xyz[own], xyz, [np.asarray(c, float).reshape(-1, len(axes)) for c in mine["near"]], far, unseen)
        out["size"], out["final"] = sizes, final
        # a neighbour has not met the position if its own tile has too few positions or sees too little
        counts = np.array([len(f) for f in found])
        there, here = (np.concatenate(found) - start) / side, np.repeat((xyz[own] - start) / side, counts, axis=0)
        tiles_of = np.floor(there)
        unmet = ((tiles_of < np.floor(here - (margin + SLACK))) | (tiles_of > np.floor(here + (margin + SLACK)))).any(1)
        if least > 1 and len(there):
            every, many = np.unique(np.floor((xyz - start) / side), axis=0, return_counts=True)
            few = {tuple(t) for t in every[many < least].tolist()}
            unmet |= np.array([tuple(t) in few for t in tiles_of.tolist()], bool) if few else False
        wanted = unmet | ~np.repeat(final, counts)
        sizes_of = np.bincount(np.repeat(np.arange(len(found)), counts), wanted, len(found)).astype(int)
        out["near"] = [c.ravel() for c in np.split(np.concatenate(found)[wanted], np.cumsum(sizes_of)[:-1])]
        return out

    return run


def cells(points: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(*axes, n, size)``: each distinct position, its points and the area or volume of its cell, null without a bound."""
    axes, d = list(axes), len(axes)
    if d not in FIRST:
        raise ValueError("cells are in two or three dimensions")
    sites = stored(positions(points, axes), "positions")
    low, high, n = _bounds(sites, axes)
    if not n:
        return sites.select(*axes, "n", F.lit(None).cast("double").alias("size"))
    extent = max(h - v for v, h in zip(low, high, strict=True)) or 1.0
    size, far = _tile_size(sites, axes, low, high, n) * SIDES[d], FAR * extent
    schema = ", ".join(f"{a} double" for a in axes) + ", n long, size double, final boolean, near array<double>"
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, done = sites.withColumn("near", F.array().cast("array<double>")), []
    while True:
        tile = [F.floor((F.col(a) - v) / size).alias(f"o_{a}") for a, v in zip(axes, low, strict=True)]
        here = left.select("*", *tile)
        # positions in emptier tiles wait for larger ones; the last tiles see everything
        least = FEW if size < extent else 1
        busy = stored(here.groupBy(*(f"o_{a}" for a in axes)).count().where(F.col("count") >= least).select(*(F.col(f"o_{a}").alias(f"t_{a}") for a in axes)), "busy-tiles")
        dealt, own = here, F.lit(True)
        for a, v in zip(axes, low, strict=True):
            at = (F.col(a) - v) / size
            dealt = dealt.withColumn(f"t_{a}", F.explode(F.sequence(F.floor(at - (MARGIN[d] + SLACK)), F.floor(at + (MARGIN[d] + SLACK)))))
            own = own & (F.col(f"o_{a}") == F.col(f"t_{a}"))
        at = [f"t_{a}" for a in axes]
        dealt = dealt.select(*axes, "n", F.when(own, F.col("near")).alias("near"), own.alias("own"), *at).join(busy, at, "left_semi")
        found = stored(dealt.repartition(parts, *at).groupBy(*at).applyInPandas(_tile_cells(axes, size, low, high, far, least), schema), "cells")
        done.append(found.where("final").select(*axes, "n", F.when(F.col("size") < float("inf"), F.col("size")).alias("size")))
        waiting = here.join(busy.toDF(*(f"o_{a}" for a in axes)), [f"o_{a}" for a in axes], "left_anti").select(*axes, "n", "near")
        # what goes on hasn't met all positions that are done now; these name it as a neighbour
        named = found.where("final").where(F.size("near") > 0).select(*(F.col(a).alias(f"by_{a}") for a in axes), F.explode(F.sequence(F.lit(0), F.size("near") - d, F.lit(d))).alias("k"), "near")
        named = named.select(*(F.col("near")[F.col("k") + i].alias(a) for i, a in enumerate(axes)), F.array(*(f"by_{a}" for a in axes)).alias("by"))
        open_ = found.where("NOT final").select(*axes, "n", "near").unionAll(waiting)
        told = open_.join(named, axes).groupBy(*axes).agg(F.flatten(F.collect_list("by")).alias("by"))
        open_ = open_.join(told, axes, "left").select(*axes, "n", F.when(F.col("by").isNull(), F.col("near")).otherwise(F.concat("near", "by")).alias("near"))
        left = stored(open_, "open-cells")
        if left.isEmpty():
            break
        size *= 4
    release(sites)
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def density(points: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(*axes, n, density)``: points of each distinct position by the size of its cell, 0 without a bound."""
    return cells(points, axes).select(*axes, "n", F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)).alias("density"))


def _levels(seeds: DataFrame, axes: Sequence[str], low: Sequence[float], high: Sequence[float], n: int) -> tuple[float, int]:
    extent = max(h - v for v, h in zip(low, high, strict=True)) or 1.0
    return extent, max(1, math.ceil(math.log2(extent / min(extent, _tile_size(seeds, axes, low, high, n) / 4))))


def nearest_seed(queries: DataFrame, seeds: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(id, d, seed)`` for the queries ``(id, *axes)``: distance and position (a struct) of the nearest seed; ties to the smallest position.

    Ids are distinct. A query with a coordinate that isn't finite, and every query where there is no seed, has none.
    """
    axes = list(axes)
    seeds = seeds.select(*axes)
    for a in axes:
        seeds, queries = seeds.where(F.abs(a) < float("inf")), queries.where(F.abs(a) < float("inf"))
    seeds = stored(seeds.distinct(), "seeds")
    low, high, n = _bounds(seeds, axes)
    at = queries.select("id", *axes)
    if not n:
        return at.where("false").select("id", F.lit(0.0).alias("d"), F.struct(*axes).alias("seed"))
    extent, depth = _levels(seeds, axes, low, high, n)

    def tile(level: int, prefix: str):
        side = extent / 2**level
        return [F.least(F.floor((F.col(a) - v) / side).cast("long"), F.lit(2**level - 1)).alias(f"{prefix}{a}") for a, v in zip(axes, low, strict=True)]

    boxes = seeds.select(*axes, *tile(depth, "t_")).groupBy(*(f"t_{a}" for a in axes)).agg(*(f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)))
    pyramid = [stored(boxes, "seed-boxes")]
    for _ in range(depth - 1):
        up = pyramid[-1].groupBy(*(F.shiftright(f"t_{a}", 1).alias(f"t_{a}") for a in axes)).agg(*(f(f"{f.__name__}_{a}").alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)))
        pyramid.append(up)
    rows = at.select("id", *axes, *(F.lit(0).cast("long").alias(f"p_{a}") for a in axes))
    for level in reversed(pyramid):
        below = level.select(*(F.shiftright(f"t_{a}", 1).alias(f"p_{a}") for a in axes), *level.columns)
        met = rows.join(below, [f"p_{a}" for a in axes])
        least, most = F.lit(0.0), F.lit(0.0)
        for a in axes:
            least = least + F.pow(F.greatest(F.col(f"min_{a}") - F.col(a), F.col(a) - F.col(f"max_{a}"), F.lit(0.0)), 2)
            most = most + F.pow(F.greatest(F.abs(F.col(a) - F.col(f"min_{a}")), F.abs(F.col(a) - F.col(f"max_{a}"))), 2)
        bound = F.min(most).over(Window.partitionBy("id"))
        rows = met.withColumn("least", least).withColumn("bound", bound).where(F.col("least") <= F.col("bound") * (1 + 1e-12)).select("id", *axes, *(F.col(f"t_{a}").alias(f"p_{a}") for a in axes))
    leaf = seeds.select(F.struct(*axes).alias("seed"), *tile(depth, "p_"))
    d2 = F.lit(0.0)
    for a in axes:
        d2 = d2 + F.pow(F.col(a) - F.col(f"seed.{a}"), 2)
    best = rows.join(leaf, [f"p_{a}" for a in axes]).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("seed"))).alias("m"))
    return best.select("id", F.sqrt("m.d2").alias("d"), F.col("m.seed").alias("seed"))


def density_image(points: DataFrame, bounds: Sequence[float], shape: Sequence[int], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(i_*, density)``: the density of the nearest position at each pixel's centre; bounds are lows and highs by turns, shape the pixels of each axis."""
    axes = list(axes)
    spark, cuts = points.sparkSession, [int(s) for s in shape]
    steps = [(bounds[2 * i + 1] - bounds[2 * i]) / c for i, c in enumerate(cuts)]
    if min(steps) <= 0:
        raise ValueError("bounds must grow along each axis")
    index, run = [], F.col("id")
    for a, c in zip(axes, cuts, strict=True):
        index.append((run % c).alias(f"i_{a}"))
        run = F.floor(run / c).cast("long")
    grid = spark.range(math.prod(cuts)).select("id", *index)
    centres = grid.select("*", *((F.lit(float(bounds[2 * k])) + (F.col(f"i_{a}") + 0.5) * steps[k]).alias(a) for k, a in enumerate(axes)))
    known = stored(density(points, axes), "density")
    near = nearest_seed(centres, known, axes).select("id", *(F.col(f"seed.{a}").alias(a) for a in axes))
    return grid.join(near, "id").join(known, axes).select(*(f"i_{a}" for a in axes), "density")
