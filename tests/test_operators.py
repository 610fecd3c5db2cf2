"""Edge cases and fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import geometry as G
from tracelake.functions.aggregates import trace_aggregate
from tracelake.operators import binning, channels, filters, graph, histogram, models, particles, segmentation, selection, spatial, traces
from tracelake.operators.filters import Spec, TimeWindow


def test_interleaved_traces(spark):
    rows = list(zip(range(7), [1, 2, 1, 1, 2, 1, 1], [0, 0, 1, 2, 0, 2, 2], strict=True))
    df = selection.with_islands(spark.createDataFrame(rows, "row_id long, tid long, itr int"))
    got = {r.row_id: (r.tid, r.isl) for r in df.collect()}
    assert got == {0: (1, 1), 2: (1, 1), 3: (1, 1), 5: (1, 2), 6: (1, 3), 1: (2, 1), 4: (2, 2)}


def test_last_is_the_global_maximum(spark):
    df = spark.createDataFrame([(0, 1, 0, True), (1, 1, 1, True), (2, 2, 0, True), (3, 2, 1, False)], "row_id long, tid long, itr int, vld boolean")
    assert [r.row_id for r in selection.last_valid(df).collect()] == [1]
    assert selection.select_iteration(df, "all").count() == 3
    assert selection.select_iteration(df, 1, False).count() == 2


def test_aggregates_skip_nan_but_first_keeps_it(spark):
    df = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 2.0), (1, 2, 4.0), (2, 3, float("nan"))], "tid long, row_id long, v double")
    got = {r.tid: r for r in df.groupBy("tid").agg(*(trace_aggregate(m, "v").alias(m) for m in ("mean", "max", "first", "last", "stdev"))).collect()}
    assert (got[1]["mean"], got[1]["max"], got[1]["last"], got[1]["stdev"]) == (3.0, 4.0, 4.0, 1.0) and math.isnan(got[1]["first"])
    assert got[2]["mean"] is None
    with pytest.raises(ValueError):
        trace_aggregate("mode", "v")


def test_range_bounds_and_nan(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, float("nan"), None])], "row_id long, v double")
    ids = lambda s: [r.row_id for r in filters.apply_specs(df, [s]).orderBy("row_id").collect()]
    assert ids(Spec("v", "loc", 1, 3)) == [0, 1, 2]
    assert ids(Spec("v", "loc", 1, 3, False, False)) == [1]
    assert ids(Spec("v", "loc", 2)) == [1, 2]
    with pytest.raises(ValueError):
        filters.with_masks(df, [Spec("w")])


def test_row_filters_reach_the_scan(spark, sf_dir):
    df = filters.apply_specs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), [Spec("l_quantity", "loc", 10, 20)]).select("l_orderkey")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "l_tax" not in plan.split("ReadSchema")[-1]


def test_time_windows(spark):
    w = [TimeWindow("b", 3, 5), TimeWindow("a", 1, 3), TimeWindow("c", 6, 7)]
    df = spark.createDataFrame([(float(t),) for t in range(9)], "t double").select("t", filters.time_channel(F.col("t"), w).alias("c"))
    assert [r.c for r in df.orderBy("t").collect()] == [None, "a", "a", "b", "b", "b", "c", "c", None]
    for bad in ([TimeWindow("a", 0, 2), TimeWindow("b", 1, 3)], [TimeWindow("a", 0, 1), TimeWindow("a", 2, 3)], [TimeWindow("a", 1, 1)]):
        with pytest.raises(ValueError):
            filters.checked_windows(bad)


def test_windows_from_cuts():
    assert filters.windows_from_boundaries(0, 10, [4, 2, 12]) == [(0, 4), (4, 4), (4, 10), (10, 10)]
    assert filters.even_windows(0, 1, 2) == [(0, 0.5), (0.5, 1)]


def test_votes(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, -1), (4, 1), (4, 1), (4, 0), (4, 0), (4, 1)], "tid long, label int")
    got = {r.tid: r.channel for r in channels.vote(df, F.col("label"), 0.65).collect()}
    assert got == {1: 0, 2: -1, 3: -1, 4: -1}


def test_photon_binning(spark):
    rows = [(1, i, float(i), 1000.0, float(i)) for i in range(4)] + [(2, 9, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "tid long, row_id long, tim double, eco double, x double")
    got = sorted((r.tid, r.chunk, r.n, r.photons, r.tim, r.x, r.bot, r.eot) for r in binning.photon_bins(df, 2500.0, values=["x"]).collect())
    assert got == [(1, 0, 3, 3000.0, 1.0, 1.0, True, False), (1, 1, 1, 1000.0, 3.0, 3.0, False, True), (2, 0, 1, 0.0, 0.0, 5.0, True, True)]


def test_precision(spark):
    rows = [(1, float(x), float(y)) for x, y in zip((0, 2, 4, 6, 8), (0, 3, 6, 9, 12), strict=True)] + [(2, 0.0, 0.0)] * 4
    r = traces.precision(spark.createDataFrame(rows, "tid long, x double, y double"), ["x", "y"]).collect()
    assert len(r) == 1 and r[0].sd_x == pytest.approx(math.sqrt(10)) and r[0].sigma_r == pytest.approx(math.sqrt((10 + 22.5) / 2))


def test_density_counts_the_point_itself(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 20.0, 0.0)], "id long, x double, y double")
    assert {r.id: r.den for r in spatial.local_density(df, 5.0).collect()} == {0: 2, 1: 2, 2: 1}


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-50, 50, (200, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if 3 <= np.hypot(*(p[i] - p[j])) <= 8}
    assert {(r.a, r.b) for r in spatial.band_pairs(df, 3.0, 8.0).collect()} == want


def test_separation_is_the_greedy_one(spark):
    rng = np.random.default_rng(2)
    p = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(*rng.uniform(0, 100, (2, 150)), rng.integers(0, 20, 150), strict=True))]
    kept: list = []
    for q in sorted(p, key=lambda q: (-q[3], q[0])):
        if all(math.hypot(q[1] - k[1], q[2] - k[2]) > 15 for k in kept):
            kept.append(q)
    got = spatial.apart(spark.createDataFrame(p, "id long, x double, y double, score double"), 15.0)
    assert {r.id for r in got.collect()} == {k[0] for k in kept}


def test_components_and_small_ones(spark):
    nodes = spark.range(10)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 6), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in graph.components(nodes, links).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}
    assert {r.id for r in graph.components(nodes, links, 3).collect()} == {1, 2, 3, 4}
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in graph.roots(path).collect()} == {0}


def test_flatten_numbers_traces_without_gaps(spark):
    a = spark.createDataFrame([(i, 1.0) for i in range(10)], "tid long, v double")
    b = spark.createDataFrame([(i, 2.0, 1) for i in range(3, 8)], "tid long, v double, extra int")
    out = channels.flatten({0: a, 1: b})
    assert "extra" not in out.columns and sorted(r.tid for r in out.collect()) == list(range(15))


def test_alignment(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(0, 100, (6, 2))
    c, s = math.cos(0.3), math.sin(0.3)
    q = p @ np.array([[c, s], [-s, c]]) + [5, -7]
    frame = lambda a: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "gri long, x double, y double")
    assert channels.rigid_plane(frame(p), frame(q)) == pytest.approx((0.3, 5, -7))
    r3 = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    r3 *= np.sign(np.linalg.det(r3))
    x = rng.normal(size=(5, 3))
    m = channels.rigid_space(x, x @ r3.T + [1, 2, 3])
    assert np.allclose(m[:3, :3], r3) and np.allclose(m[:3, 3], [1, 2, 3])
    assert [channels.effective_transform("rigid_xyz", n) for n in (2, 3, 4)] == ["translation", "rigid_xy_z", "rigid_xyz"]


def test_mixture_recovery(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0.3, 0.05, 4000), rng.normal(0.7, 0.06, 3000)])
    x, n = models.binned(spark.createDataFrame([(float(a),) for a in v], "v double"), "v")
    fit = models.fit_mixture(x, n, 2)
    assert [p[0] for p in fit["params"]] == pytest.approx([0.3, 0.7], abs=0.01)
    assert fit["weights"] == pytest.approx([4 / 7, 3 / 7], abs=0.02)
    cut = G.decision_boundary(*[(w, *p) for w, p in zip(fit["weights"], fit["params"], strict=True)])
    assert 0.4 < cut < 0.6
    assert len(models.search_mixture(x, n, ("gaussian",))["params"]) == 2


def test_drift_recovery(spark):
    rng = np.random.default_rng(5)
    sites = rng.uniform(0, 2000, (150, 2))
    t = np.sort(rng.uniform(0, 1000, 12_000))
    k = rng.integers(0, 150, len(t))
    moved = np.stack([0.12 * t, 60 * np.sin(t / 300)], 1)
    p = sites[k] + moved + rng.normal(0, 4, (len(t), 2))
    df = spark.createDataFrame([(i, float(a), float(x), float(y)) for i, (a, (x, y)) in enumerate(zip(t, p, strict=True))], "id long, tim double, x double, y double")
    found = models.drift(df, 99.0, 10.0)
    got = np.array([(r.dx, r.dy) for r in found.orderBy("w").collect()])
    centres = t[0] + 99.0 * (np.arange(len(got)) + 0.5)
    want = np.stack([0.12 * centres, 60 * np.sin(centres / 300)], 1)
    assert np.abs(got - (want - want[0])).max() < 12
    back = np.array([(r.x, r.y) for r in models.without_drift(df, found, 99.0).orderBy("id").collect()])
    residual = back - sites[k]
    assert (residual - residual.mean(0)).std() < 0.3 * (p - sites[k] - (p - sites[k]).mean(0)).std()


def test_resolution_falls_with_blur(spark):
    rng = np.random.default_rng(6)
    sites = rng.uniform(0, 2000, (200, 2))
    out = []
    for blur in (20, 60):
        p = np.repeat(sites, 40, axis=0) + rng.normal(0, blur, (8000, 2))
        df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
        curve = models.ring_correlation(df, 10.0, 2)
        out.append(models.resolution(curve, 10.0, 2 * curve.count()))
    assert out[0] is not None and out[1] is not None and out[0] < out[1]


def test_rings_are_found(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[300, 300], [900, 500], [500, 1100]])
    a = rng.uniform(0, 2 * np.pi, (3, 200))
    rings = centres[:, None] + np.stack([60 * np.cos(a), 60 * np.sin(a)], -1) + rng.normal(0, 4, (3, 200, 2))
    p = np.concatenate([rings.reshape(-1, 2), rng.uniform(0, 1400, (300, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    for side in (64, 256):
        found = segmentation.validated(segmentation.detections(df, 10.0, "ring", 60.0, 10.0, 3.0, side), df, 60.0, 20.0).collect()
        near = {int(np.hypot(*(centres - [r.x, r.y]).T).argmin()) for r in found if np.hypot(*(centres - [r.x, r.y]).T).min() < 20}
        assert near == {0, 1, 2}


def test_skeleton_follows_a_line(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 600, 6000)
    p = np.stack([x, 200 + 0.3 * x + rng.normal(0, 8, 6000)], 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in p], "x double, y double")
    got = np.array([(r.i_x, r.i_y) for r in segmentation.skeleton(df, 10.0, threshold=0.3, side=32).collect()])
    off = np.abs((got[:, 1] + 0.5) * 10 - 200 - 3 * (got[:, 0] + 0.5))
    assert len(got) >= 40 and np.median(off) < 12


def test_hulls(spark):
    rng = np.random.default_rng(9)
    p = rng.uniform(0, 1, (500, 2))
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    rows = [(1, x, y) for x, y in square] + [(1, float(4 * x), float(2 * y)) for x, y in p] + [(2, 5.0, 5.0)]
    r = {x.particle: x for x in particles.hull_shapes(particles.hull(spark.createDataFrame(rows, "particle long, x double, y double"))).collect()}
    assert r[1].area == pytest.approx(8) and r[1].rect_area == pytest.approx(8) and r[1].radius == pytest.approx(math.sqrt(5)) and r[2].radius == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 4.0, float("nan"))], "v double")
    assert {r.bin: r.n for r in histogram.histogram(df, "v", 4).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert [r.n for r in histogram.histogram(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").collect()] == [5]
    assert histogram.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_approach_is_cut(spark):
    rows = [(1, i, float(i), x, 0.0, 0.0) for i, x in enumerate([90.0, 60.0, 30.0, 1.0, 0.0, 2.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "tid long, row_id long, tim double, x double, y double, z double")
    got = [r.tid for r in traces.without_approach(df, ["x", "y"], 3, 24.0).orderBy("row_id").collect()]
    assert set(got) <= {0, 1} and got[-1] == 1 and got == sorted(got)


def test_half_width(spark):
    x = np.arange(-50, 51)
    df = spark.createDataFrame([(float(a), float(np.exp(-(a / 10) ** 2 / 2))) for a in x], "x double, v double")
    assert models.half_width(df).first()[0] == pytest.approx(23.55, abs=0.3)


def test_headers(spark):
    df = spark.createDataFrame([("X position [nm]",), ("time_ms",)], "h string")
    got = [(r.k, r.u) for r in df.select(G.header_key(F.col("h")).alias("k"), G.header_unit(F.col("h")).alias("u")).collect()]
    assert got == [("xposition", "nm"), ("timems", "ms")]
