"""Work on neighbours tile by tile: no table of pairs is made, and full tiles are done in parts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import graph, resampling, spatial, tiles


@pytest.fixture
def crowd(spark, monkeypatch):
    """Points with a dense spot; tiles of at most 20 points, and pair tables forbidden."""
    monkeypatch.setattr(tiles, "FULL", 20)
    monkeypatch.setattr(spatial, "near_pairs", lambda *a, **k: pytest.fail("a table of pairs"))
    rng = random.Random(5)
    rows = [(i, rng.uniform(-30, 30), rng.uniform(0, 40), float(rng.randrange(9))) for i in range(250)]
    rows += [(250 + i, rng.gauss(3, 1), rng.gauss(4, 1), float(rng.randrange(9))) for i in range(150)]
    return {r[0]: r[1:] for r in rows}, spark.createDataFrame(rows, "id long, x double, y double, z double")


def gap(a, b):
    return math.sqrt(0.0 + (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


@pytest.mark.parametrize("name", ["neighbour_distance", "kth_distance"])
def test_spacing(crowd, name):
    at, df = crowd
    got = {r.id: r.d for r in getattr(spatial, name)(df, 4, 6.0).collect()}
    want = {i: sorted(gap(p, q) for j, q in at.items() if j != i)[3] for i, p in at.items()}
    if name == "neighbour_distance":
        want = {i: d for i, d in want.items() if d <= 6.0}
    assert got == pytest.approx(want)


def test_profile_and_pairs(crowd):
    at, df = crowd
    want = {(i, j): gap(at[i], at[j]) for i in at for j in at if i < j and gap(at[i], at[j]) <= 5.0}
    got = spatial.band_pairs(df, 1.0, 5.0).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b): r.d for r in got} == pytest.approx({k: d for k, d in want.items() if d >= 1.0})
    bins = {r.bin: r.n for r in spatial.pair_profile(df, 5.0, 1.0).collect()}
    assert bins == Counter(min(int(d), 4) for d in want.values())
    assert {r.id: r.den for r in spatial.local_density(df, 5.0).collect()} == {i: 1 + sum(i in k for k in want) for i in at}


def test_envelope(crowd):
    at, df = crowd
    made = df.select("id", "x", "y").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    for k, a in enumerate(("x", "y")):
        made = made.withColumn(a, (F.floor(F.col(a) / 10.0) + resampling.uniform("id", "rep", k)) * 10.0)
    reps = [[(r.x, r.y) for r in made.where(f"rep = {n}").collect()] for n in range(3)]
    counts = [Counter(min(int(d), 3) for i, p in enumerate(rep) for q in rep[:i] if (d := gap(p, q)) <= 4.0) for rep in reps]
    for r in resampling.envelope(df, 10.0, 4.0, 1.0, 3).collect():
        n = [c[r.bin] for c in counts]
        assert r.mean == pytest.approx(sum(n) / 3) and r.sd == pytest.approx(math.sqrt(sum((v - sum(n) / 3) ** 2 for v in n) / 3))


def test_weighted_depth(crowd):
    at, df = crowd
    got = {r.id: r.depth for r in spatial.weighted_depth(df, 5.0, 3.0).collect()}
    for i, p in at.items():
        near = sorted((q[2], j, math.exp(-(gap(p, q) ** 2) / 18)) for j, q in at.items() if gap(p, q) <= 5.0)
        total, run = sum(w for *_, w in near), 0.0
        for z, _, w in near:
            run += w
            if run >= total / 2:
                break
        assert got[i] == z


def test_suppression(crowd):
    at, df = crowd
    kept = []
    for i in sorted(at, key=lambda i: (-at[i][2], i)):
        if all(gap(at[i], at[j]) > 4.0 for j in kept):
            kept.append(i)
    odd = df.sparkSession.createDataFrame([(900, 1.0, 1.0, None), (901, None, 1.0, 3.0), (902, float("nan"), 1.0, 3.0)], "id long, x double, y double, z double")
    got = spatial.apart(df.unionAll(odd).withColumnRenamed("z", "score"), 4.0)
    assert {r.id for r in got.collect()} == {*kept, 900, 901, 902}


def test_dbscan(crowd):
    at, df = crowd
    near = {i: [j for j in at if gap(at[i], at[j]) <= 2.0] for i in at}
    core = {i for i in at if len(near[i]) >= 4}
    root = {i: i for i in core}
    changed = True
    while changed:
        low = {i: min(root[j] for j in near[i] if j in core) for i in core}
        changed, root = low != root, low
    want = {i: root[i] if i in core else min((root[j] for j in near[i] if j in core), default=-1) for i in at}
    assert -1 in want.values() and {r.id: r.cluster for r in graph.dbscan(df, 2.0, 4).collect()} == want


def test_pairs_within_groups(crowd, monkeypatch):
    """Links and pairs meet in tiles only: of the tables that are stored, none has a row a pair."""
    at, df = crowd
    near = {i: [j for j in at if gap(at[i], at[j]) <= 2.0] for i in at}
    root, changed = {i: i for i in at}, True
    while changed:
        low = {i: min(root[j] for j in near[i]) for i in at}
        changed, root = low != root, low
    want = {(root[i], i, j): gap(at[i], at[j]) for i in at for j in at if i < j and gap(at[i], at[j]) <= 5.0 and root[i] == root[j]}
    links = []
    roots = graph.roots
    monkeypatch.setattr(graph, "roots", lambda df: links.append(df.count()) or roots(df))
    got = resampling.within_groups(df, 2.0, 5.0, ("x", "y"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.group, r.a, r.b): r.d for r in got.collect()} == pytest.approx(want)
    assert got.columns == ["group", "a", "b", "d"] and links[0] < sum(map(len, near.values())) / 4
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


@pytest.mark.parametrize("equal", [False, True])
def test_suppression_of_a_crowd_in_batches(crowd, monkeypatch, equal):
    """Peaks that a stronger batch suppresses are gone before tiles are dealt."""
    at, df = crowd
    monkeypatch.setattr(spatial, "SPARSE", 3)
    monkeypatch.setattr(spatial, "PEAKS", 20)
    monkeypatch.setattr(spatial, "LOOK", 2)
    batches = []
    suppressed = spatial._suppressed
    monkeypatch.setattr(spatial, "_suppressed", lambda df, *a: batches.append(df.count()) or suppressed(df, *a))
    score, kept = (lambda i: 0.0 if equal else at[i][2]), []
    for i in sorted(at, key=lambda i: (-score(i), i)):
        if all(gap(at[i], at[j]) > 4.0 for j in kept):
            kept.append(i)
    got = spatial.apart(df.select("id", "x", "y", F.lit(0.0).alias("score") if equal else F.col("z").alias("score")), 4.0)
    assert {r.id for r in got.collect()} == set(kept)
    assert len(batches) > 1 and sum(batches) < len(at) / 2


@pytest.mark.parametrize("half", [False, True])
def test_finer_cells_gather_little_more_than_the_radius(half):
    rng = np.random.default_rng(3)
    at = np.floor(rng.uniform(0, 100, (4000, 2)))  # many distances of exactly the radius
    grid = tiles.Grid(10.0, 10.0 * (1 + 1e-9), 40.0, ("x", "y"), False, fine=4)
    met, looked = set(), 0
    for i, j, same in tiles.gathered(at, at, grid, half):
        looked += len(i) * len(j)
        d2 = ((at[i][:, None] - at[j][None]) ** 2).sum(-1)
        if half:
            d2[:, :same][i[:, None] >= j[None, :same]] = np.inf
        k, m = np.nonzero(d2 <= 100)
        met |= set(zip(np.minimum(i[k], j[m]).tolist(), np.maximum(i[k], j[m]).tolist(), strict=True)) if half else set(zip(i[k].tolist(), j[m].tolist(), strict=True))
    want = ((at[:, None] - at[None]) ** 2).sum(-1) <= 100
    p, q = np.nonzero(np.triu(want, 1) if half else want)
    assert met == set(zip(p.tolist(), q.tolist(), strict=True)) and looked < 2.2 * len(p)


def test_profile_on_edges_of_bins(spark, monkeypatch):
    """Distances of exactly a bin's edge, in cells finer than the reach."""
    monkeypatch.setattr(tiles, "CROWD", 8)
    rng = np.random.default_rng(1)
    spots = [(float(x), float(y)) for x in range(16) for y in range(16) for _ in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "id long, x double, y double")
    grid = tiles.grid_of(df, 5.0)
    assert grid.fine > 1
    got = {r.bin: r.n for r in spatial.pair_profile(df, 5.0, 1.0).collect()}
    assert got == Counter(min(int(d), 4) for k, p in enumerate(spots) for q in spots[:k] if (d := gap(p, q)) <= 5.0)


def test_weighted_depth_in_a_crowd(spark, monkeypatch):
    """Full cells, many points on the radius and equal depths; only what is gathered around a cell is weighed."""
    monkeypatch.setattr(tiles, "CROWD", 8)
    rng = np.random.default_rng(2)
    at = {k: (float(rng.integers(0, 16)), float(rng.integers(0, 16)), float(rng.integers(0, 7))) for k in range(700)}
    df = spark.createDataFrame([(k, *p) for k, p in at.items()], "id long, x double, y double, z double")
    assert tiles.grid_of(df, 5.0).fine > 1
    got = {r.id: r.depth for r in spatial.weighted_depth(df, 5.0, 3.0).collect()}
    for i, p in at.items():
        near = sorted((q[2], math.exp(-(gap(p, q) ** 2) / 18)) for q in at.values() if gap(p, q) <= 5.0)
        total = math.fsum(w for _, w in near)
        run = {z: math.fsum(w for v, w in near if v <= z) for z, _ in near}
        assert got[i] == min(z for z in run if run[z] >= total / 2 - 1e-9) or abs(run[got[i]] - total / 2) < 1e-9
    assert len(got) == len(at)


def test_points_are_dealt_once(spark):
    """A tile's own points are among those around it; they aren't shuffled a second time."""
    df = spark.createDataFrame([(k, float(k % 9), float(k // 9)) for k in range(81)], "id long, x double, y double")
    got = spatial.band_pairs(df, 1.0, 1.0)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.b) for r in got.collect()} == {(k, k + 1) for k in range(81) if k % 9 < 8} | {(k, k + 9) for k in range(72)}
