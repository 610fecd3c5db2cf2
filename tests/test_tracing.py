"""Skeleton paths against a walk over the pixel graph."""

import math
import random

import pytest

from tracelake.operators import tracing


def walk(pixels, least=1):
    """The branches between pixels with other than two neighbours, one step at a time; then rings."""
    pixels = set(pixels)
    near = {p: sorted((p[0] + dx, p[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (p[0] + dx, p[1] + dy) in pixels) for p in pixels}
    nodes, out, seen = {p for p in pixels if len(near[p]) != 2}, set(), set()

    def follow(start, first, stop):
        path = [start, first]
        while path[-1] not in stop:
            path.append(next(q for q in near[path[-1]] if q != path[-2]))
        return path

    for start in nodes:
        for first in near[start]:
            path = follow(start, first, nodes)
            seen |= set(path)
            out.add(min(tuple(path), tuple(path[::-1]), key=lambda p: p[:2]))
    for p in sorted(pixels - seen - nodes):
        if p not in seen:
            path = follow(p, near[p][0], {p})
            seen |= set(path)
            out.add(min(tuple(path), tuple(path[::-1]), key=lambda p: p[:2]))
    return {p for p in out if len(p) >= least}


def found(spark, pixels, least=1):
    df = spark.createDataFrame([(*p, 1) for p in pixels], "i_x long, i_y long, n int")
    paths = {}
    for r in tracing.traced(df, least).collect():
        paths.setdefault(r.path, {})[r.k] = (r.i_x, r.i_y)
    assert all(sorted(p) == list(range(len(p))) for p in paths.values())
    return {tuple(p[k] for k in range(len(p))) for p in paths.values()}


@pytest.mark.parametrize("density", [0.1, 0.3, 0.5])
def test_random_pixels(spark, density):
    rng = random.Random(density)
    pixels = [(x, y) for x in range(-20, 20) for y in range(-15, 15) if rng.random() < density]
    assert found(spark, pixels + pixels[:10]) == walk(pixels)


def test_long_branches_rings_and_lengths(spark):
    line = [(x, 5) for x in range(300)]
    cross = [(150, y) for y in range(6, 40)]
    ring = [(x, y) for x in range(500, 511) for y in range(11) if abs(x - 505) + abs(y - 5) == 5]
    pixels = line + cross + ring + [(900, 900)]
    got = found(spark, pixels)
    assert got == walk(pixels) and any(len(p) > 140 for p in got) and any(p[0] == p[-1] for p in got) and not any((900, 900) in p for p in got)
    assert found(spark, pixels, 30) == walk(pixels, 30)
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "i_x long, i_y long")
    one = tracing.path_lengths(tracing.traced(df), 10.0).collect()
    assert [(r.path, r.pixels, round(r.length, 6)) for r in one] == [("0,0,1,1", 3, round(10 * (1 + math.sqrt(2)), 6))]
    assert tracing.traced(df.where("false")).count() == 0
