"""Masks as runs against plain loops over pixels, and cells with known borders."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import masks
from tracelake.operators.masks import Frame


def runs(spark, m):
    return masks.runs_of(spark.createDataFrame([(int(x), int(y)) for x, y in np.argwhere(m)], "i_x long, i_y long"))


def image(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        assert not out[r.a : r.b + 1, r.i_y].any() and 0 <= r.a <= r.b < shape[0] and 0 <= r.i_y < shape[1]
        out[r.a : r.b + 1, r.i_y] = True
    return out


def grow(m, r):
    out = np.zeros_like(m)
    for x, y in np.argwhere(m):
        for dx in range(-r, r + 1):
            for dy in range(-r, r + 1):
                if dx * dx + dy * dy <= r * r and 0 <= x + dx < m.shape[0] and 0 <= y + dy < m.shape[1]:
                    out[x + dx, y + dy] = True
    return out


def shrink(m, r):
    return ~grow(~np.pad(m, r), r)[r:-r, r:-r]


def parts(m):
    """The four-neighbour components, as sets of pixels."""
    left, out = set(map(tuple, np.argwhere(m))), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            seen.add((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(seen)
    return out


@pytest.mark.parametrize("density", [0.03, 0.6])
def test_morphology(spark, density):
    m = np.random.default_rng(1).uniform(size=(90, 25)) < density
    frame, df = Frame(0, 89, 0, 24), runs(spark, m).cache()
    assert (image(df, m.shape) == m).all() and (image(masks.complement(df, frame), m.shape) == ~m).all()
    assert (image(masks.grown(df, 2, frame), m.shape) == grow(m, 2)).all()
    assert (image(masks.shrunk(masks.grown(df, 3, frame), 2, frame), m.shape) == shrink(grow(m, 3), 2)).all()
    assert (image(masks.opened(df, 1, frame), m.shape) == grow(shrink(m, 1), 1)).all()


@pytest.mark.parametrize("density", [0.4, 0.62])
def test_components_holes_and_distances(spark, density):
    m = np.random.default_rng(2).uniform(size=(80, 24)) < density
    frame, df = Frame(0, 79, 0, 23), runs(spark, m).cache()
    got = {}
    for r in masks.pixels_of(masks.labelled(df)).collect():
        got.setdefault(r.label, set()).add((r.i_x, r.i_y))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts(m)))
    assert {k: min(v) for k, v in got.items()} == {k: (k // masks.SPAN - masks.SPAN // 2, k % masks.SPAN - masks.SPAN // 2) for k in got}
    holes = np.zeros_like(m)
    for p in parts(~m):
        if not any(x in (0, 79) or y in (0, 23) for x, y in p):
            holes[tuple(zip(*p, strict=True))] = True
    assert (image(masks.filled(df, frame), m.shape) == m | holes).all() and holes.any()
    inner = np.pad(np.random.default_rng(3).uniform(size=(60, 30)) < 0.97, 2)
    zeros = np.argwhere(~inner)
    want = {(x, y): math.sqrt(((zeros - (x, y)) ** 2).sum(1).min()) for x, y in map(tuple, np.argwhere(inner))}
    got = {(r.i_x, r.i_y): r.d for r in masks.distances(runs(spark, inner)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_smoothing_is_mirrored_and_keeps_mass(spark):
    df = spark.createDataFrame([(0, 0, 3.0), (5, 2, 1.0)], "i_x long, i_y long, v double")
    got = {(r.i_x, r.i_y): r.v for r in masks.blurred(df, 1.2, Frame(0, 5, 0, 3)).collect()}
    plain = np.zeros((6, 4))
    plain[0, 0], plain[5, 2] = 3, 1
    r = int(4 * 1.2 + 0.5)
    g = np.exp(-((np.arange(-r, r + 1) / 1.2) ** 2) / 2)
    for axis in (0, 1):
        padded = np.pad(plain, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        plain = sum(w * np.take(padded, range(i, i + plain.shape[axis]), axis) for i, w in enumerate(g / g.sum()))
    assert all(math.isclose(plain[k], v) for k, v in got.items()) and math.isclose(sum(got.values()), 4)
    assert masks.otsu_level(df.where("false"), Frame(0, 1, 0, 1)) is None


def test_cells(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform((0, 0), (2000, 800), (6000, 2)), rng.uniform((3500, 0), (4300, 800), (2400, 2))
    xy = [*a, *b, (8000.0, 8000.0), (1000.0, 400.0)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    c = masks.cells(points, border=200.0)
    sizes = sorted((r.area, r.half_width) for r in c.table().collect())
    assert len(sizes) == 2 and abs(sizes[0][0] / 640_000 - 1) < 0.15 and abs(sizes[1][0] / 1_600_000 - 1) < 0.15 and all(380 <= w <= 460 for _, w in sizes)
    got = {r.id: r for r in c.of(points).collect()}
    assert len(got) == len(xy) and got[8400].cell is None and got[8400].border and got[8400].edge == 0
    assert not got[8401].border and abs(got[8401].edge - 400) < 50
    assert len({got[i].cell for i in range(6000)} - {None}) == 1
    near = [i for i, (x, y) in enumerate(a) if min(x, y, 2000 - x, 800 - y) < 150]
    deep = [i for i, (x, y) in enumerate(a) if min(x, y, 2000 - x, 800 - y) > 260]
    assert all(got[i].border for i in near) and not any(got[i].border for i in deep)
    half = masks.cells(points, share=0.9).of(points).where(~F.col("border")).count()
    assert 0 < half < len(deep)
    empty = masks.cells(points.where("false"))
    assert empty.table().count() == 0 and all(r.border for r in empty.of(points).collect())
    with pytest.raises(ValueError):
        masks.cells(points, size=0.0)
