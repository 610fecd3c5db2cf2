"""Voronoi cells against half-plane clipping, known lattices and random marks; nearest seeds against all pairs."""

import math

import numpy as np
import pandas as pd
import pytest

from tracelake.operators import voronoi


def clipped_area(p, others, big=1e9):
    """Area of a cell by cutting a large square with each bisector; None without a bound."""
    poly = [np.array(v, float) for v in ((-big, -big), (big, -big), (big, big), (-big, big))]
    for q in others:
        normal = q - p
        if not normal.any():
            continue
        c, out = normal @ (p + q) / 2, []
        for a, b in zip(poly, poly[1:] + poly[:1], strict=True):
            da, db = normal @ a - c, normal @ b - c
            if da <= 0:
                out.append(a)
            if da * db < 0:
                out.append(a + (b - a) * da / (da - db))
        poly = out
    x = np.array(poly)
    if np.abs(x).max() > 2e7:
        return None
    return abs((x[:, 0] * np.roll(x[:, 1], -1) - x[:, 1] * np.roll(x[:, 0], -1)).sum()) / 2


def frame(spark, xyz):
    axes = ["x", "y", "z"][: len(xyz[0])] if len(xyz) else ["x", "y"]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, " + ", ".join(f"{a} double" for a in axes))


def test_areas_equal_clipping(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.uniform(0, 100, (300, 2)), rng.normal(30, 0.5, (250, 2)), np.round(rng.uniform(0, 100, (99, 2)) / 10) * 10, [[400.0, -300.0]]])
    distinct = np.unique(pts, axis=0)
    want = {tuple(p): clipped_area(p, distinct[np.argsort(((distinct - p) ** 2).sum(1))]) for p in distinct}
    monkeypatch.setattr(voronoi, "TILE", 20)
    monkeypatch.setattr(voronoi, "CROWD", 100)
    got = voronoi.cells(frame(spark, pts)).collect()
    assert len(got) == len(distinct) and sum(r.n for r in got) == len(pts)
    for r in got:
        area = want[r.x, r.y]
        assert (r.size is None) == (area is None)
        assert area is None or math.isclose(r.size, area, rel_tol=2e-5)  # the large square costs the clipping digits


def test_lattices(spark):
    """Inner cells of a square lattice of side 10 have 1/100, a doubled position twice that, the border none."""
    grid = np.stack(np.meshgrid(range(5), range(5)), -1).reshape(-1, 2) * 10.0
    got = {(r.x, r.y): r for r in voronoi.density(frame(spark, grid + [0.125, 0.375])).collect()}
    assert len(got) == 25 and sum(r.density > 0 for r in got.values()) == 9
    assert math.isclose(got[20.125, 20.375].density, 0.01) and got[0.125, 0.375].density == 0
    doubled = {(r.x, r.y): r for r in voronoi.density(frame(spark, [*grid, (20, 20)])).collect()}
    assert len(doubled) == 25 and math.isclose(doubled[20, 20].density, 0.02) and doubled[20, 20].n == 2
    cube = np.stack(np.meshgrid(range(4), range(5), range(5)), -1).reshape(-1, 3) * [10.0, 10.0, 20.0]
    sizes = [r.size for r in voronoi.cells(frame(spark, cube), ["x", "y", "z"]).collect()]
    assert sum(s is not None for s in sizes) == 18 and all(s is None or math.isclose(s, 2000) for s in sizes)


def test_volumes(spark, monkeypatch):
    """Marks thrown at random fall into cells by their volumes; the cells don't depend on the tiles."""
    rng = np.random.default_rng(2)
    pts = rng.uniform(0, 1, (500, 3))
    by_tile = []
    for tile in (30, 600):
        monkeypatch.setattr(voronoi, "TILE", tile)
        by_tile.append({(r.x, r.y, r.z): r.size for r in voronoi.cells(frame(spark, pts), ["x", "y", "z"]).collect()})
    assert by_tile[0].keys() == by_tile[1].keys()
    assert all((a is None) == (by_tile[1][k] is None) and (a is None or math.isclose(a, by_tile[1][k], rel_tol=1e-6)) for k, a in by_tile[0].items())
    marks = rng.uniform(0, 1, (200_000, 3))
    hits = np.bincount(np.concatenate([((marks[i : i + 2000, None] - pts[None]) ** 2).sum(-1).argmin(1) for i in range(0, len(marks), 2000)]), minlength=500)
    inner = np.abs(pts - 0.5).max(1) < 0.25
    size = np.array([by_tile[0][tuple(p)] or np.inf for p in pts])[inner]
    expected = size * len(marks)
    assert inner.sum() > 40 and (np.abs(hits[inner] - expected) < 5 * np.sqrt(expected) + 5).all()
    assert abs(hits[inner].sum() / expected.sum() - 1) < 0.02


@pytest.mark.parametrize("rows", [[], [(1, 2)], [(1, 2)] * 3, [(i, 2 * i) for i in range(8)], [(0, 0), (1, 0), (0, 1)]])
def test_cells_without_a_bound(spark, rows):
    got = voronoi.cells(frame(spark, rows)).collect()
    assert len(got) == len(set(rows)) and all(r.size is None for r in got) and sum(r.n for r in got) == len(rows)


def test_other_numbers(spark):
    rows = [(1, float("nan"), 0.0), (2, float("inf"), 0.0), (3, None, 1.0), (4, 0.0, -0.0), (5, -0.0, 0.0), (6, 1.0, 1.0)]
    got = voronoi.cells(spark.createDataFrame(rows, "n long, x double, y double")).collect()
    assert sorted((r.x, r.y, r.n) for r in got) == [(0, 0, 2), (1, 1, 1)]
    with pytest.raises(ValueError, match="dimensions"):
        voronoi.cells(frame(spark, [(1, 2)]), ["x"])


@pytest.mark.parametrize("d", [2, 3])
def test_nearest_seed(spark, monkeypatch, d):
    monkeypatch.setattr(voronoi, "TILE", 4)
    monkeypatch.setattr(voronoi, "CROWD", 16)
    rng = np.random.default_rng(d)
    seeds = np.concatenate([rng.uniform(0, 10, (150, d)), rng.normal(3, 0.01, (150, d)), [[5.0] * d] * 3])
    asked = np.concatenate([rng.uniform(-5, 15, (150, d)), [[1e6] * d, [-400.0] + [3.0] * (d - 1)], seeds[:20]])
    axes = ["x", "y", "z"][:d]
    got = {r.id: r for r in voronoi.nearest_seed(frame(spark, asked), frame(spark, seeds), axes).collect()}
    assert len(got) == len(asked)
    for i, q in enumerate(asked):
        d2 = ((seeds - q) ** 2).sum(1)
        best = min(map(tuple, seeds[d2 <= d2.min() * (1 + 1e-12)]))
        assert math.isclose(got[i].d, math.sqrt(d2.min()), rel_tol=1e-9, abs_tol=1e-12) and tuple(got[i].seed) == best
    assert voronoi.nearest_seed(frame(spark, asked), frame(spark, seeds).where("false"), axes).count() == 0


def test_images_of_parts_are_parts_of_the_image(spark):
    grid = np.stack(np.meshgrid(range(5), range(5)), -1).reshape(-1, 2) * 10.0
    points = frame(spark, grid)

    def image(bounds, shape):
        out = np.full(shape, np.nan)
        for r in voronoi.density_image(points, bounds, shape).collect():
            out[r.i_x, r.i_y] = r.density
        return out

    assert np.allclose(image((19.5, 20.5, 19.5, 20.5), (1, 1)), 0.01)
    whole = image((0, 40, 0, 40), (16, 16))
    assert np.array_equal(np.concatenate([image((0, 20, 0, 40), (8, 16)), image((20, 40, 0, 40), (8, 16))]), whole) and not np.isnan(whole).any()
    with pytest.raises(ValueError, match="grow"):
        image((1, 1, 0, 1), (2, 2))


def test_cells_on_the_edge_of_a_set_are_final_in_their_tile():
    """Else all of them would meet in the last tile, one task."""
    pdf = pd.DataFrame([(float(x), float(y), x < 20) for x in range(40) for y in range(10)], columns=["x", "y", "own"])
    pdf = pdf.assign(n=1, t_x=0, t_y=0, near=[np.zeros(0)] * len(pdf))
    out = voronoi._tile_cells(["x", "y"], 20.0, [0.0, 0.0], [999.0, 9.0], 1e5 * 999)(pdf)
    assert len(out) == 200 and out["final"].all()
    assert np.isinf(out["size"]).sum() == 10 + 2 * 19 and np.allclose(out["size"][np.isfinite(out["size"])], 1.0)
    # not if the set goes on where that may matter
    lower = voronoi._tile_cells(["x", "y"], 20.0, [0.0, -50.0], [999.0, 9.0], 1e5 * 999)(pdf.assign(t_y=2))
    assert lower["final"].sum() < 200 and not lower["final"][lower["y"] == 0].any()


def test_many_cells_of_the_plane_at_once(monkeypatch):
    """Cells among the nearest positions, many at once: the same as one by one, which few still need."""
    rng = np.random.default_rng(4)
    xy = np.unique(np.concatenate([rng.uniform(0, 30, (700, 2)), np.floor(rng.uniform(0, 30, (400, 2))), rng.normal(15, 0.2, (200, 2))]), axis=0)
    own = xy[(np.abs(xy - 15) < 10).all(1)]
    none = [np.zeros((0, 2))] * len(own)
    unseen = [(np.array([30.0, 0.0]), np.array([99.0, 99.0]))]
    want = voronoi.cells_of(own, xy, none, 1e6, unseen)
    left, one_by_one = [], voronoi.cells_of
    monkeypatch.setattr(voronoi, "cells_of", lambda own, *a: left.append(len(own)) or one_by_one(own, *a))
    got = voronoi.plane_cells(own, xy, none, 1e6, unseen)
    np.testing.assert_allclose(got[0], want[0], rtol=1e-9)
    assert (got[1] == want[1]).all() and sum(left) < len(own) / 4
    assert all({tuple(p) for p in a.tolist()} == {tuple(p) for p in b.tolist()} for a, b in zip(got[2], want[2], strict=True))
