"""Results that a user of iteration filters, regions and renders expects, written down by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import geometry as G
from tracelake.operators import iterations, paths, regions, renders
from tracelake.operators.iterations import IterationSpec
from tracelake.operators.regions import Region
from tracelake.sources import sets

# ---- iteration filters -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def recording(spark):
    """8 localizations of 4 iterations, two a trace: dcr is 0.1 to 0.4, efo 1000 times the iteration plus the localization; cfr is there at iteration 1 only."""
    rows = []
    for loc in range(8):
        for itr in range(4):
            cfr = 0.3 + 0.5 * loc / 7 if itr == 1 else 0.0
            rows.append((loc // 2, len(rows), itr, True, 0.1 * (itr + 1), 1000.0 * itr + loc, cfr))
    return spark.createDataFrame(rows, "tid long, row_id long, itr int, vld boolean, dcr double, efo double, cfr double").cache()


def passing(df, *specs, **options):
    return {r.row_id for r in iterations.apply_iteration_specs(df, specs, **options)[0].collect()}


def test_specs_take_their_own_iteration(recording):
    upper = set(range(16, 32))
    assert passing(recording, IterationSpec("efo", 3004)) == upper  # the last one, for all four rows of a localization
    assert passing(recording, IterationSpec("efo", 3004, None, "LAST ")) == passing(recording, IterationSpec("efo", 3004, None, "nonsense")) == upper
    assert passing(recording, IterationSpec("efo", 1004, 1100, 1)) == passing(recording, IterationSpec("efo", 1004, 1100, "1")) == upper
    assert passing(recording, IterationSpec("efo", 3004, lo_inc=False)) == set(range(20, 32))
    assert passing(recording, IterationSpec("efo", 1000, 1007, "all")) == passing(recording, IterationSpec("efo", 1000, 1007, "browse")) == {4 * k + 1 for k in range(8)}
    assert passing(recording, IterationSpec("efo", 3006, None, mode="min")) == set(range(24, 32))  # by the least of a trace


def test_measured_attributes(recording):
    measured = iterations.measured_iterations({"cfr_iteration": "2", "efc_iteration": 4}, 4)
    assert measured == {"cfr": 1}  # an effective iteration that is the last anyway is none
    assert iterations.measured_iterations({"cfr_iteration": "?", "efc_iteration": 0}, 4) == {}
    at = 0.3 + 0.5 * 5 / 7
    assert passing(recording, IterationSpec("cfr", at - 1e-9), measured=measured) == set(range(20, 32))
    assert passing(recording, IterationSpec("cfr", at - 1e-9)) == set()  # without metadata the last value, which is 0
    assert passing(recording, IterationSpec("efo", 3004, None, "effective"), measured=measured) == set(range(16, 32))


def test_pooled_values(spark, recording):
    assert passing(recording, IterationSpec("dcr", 0.99, 1.01, "sum")) == passing(recording, IterationSpec("dcr", 0.24, 0.26, "average")) == set(range(32))
    assert passing(recording, IterationSpec("dcr", 2, 3, "sum")) == set()
    holes = recording.withColumn("dcr", F.when(F.col("itr") == 0, float("nan")).otherwise(F.col("dcr")))
    assert passing(holes, IterationSpec("dcr", 0.899, 0.901, "sum"), IterationSpec("dcr", 0.299, 0.301, "average")) == set(range(32))
    rows = [(1, 0, 0, True, 10.0), (1, 1, 1, False, 100.0), (1, 2, 2, True, 5.0), (2, 3, 0, True, 15.0), (2, 4, 1, True, 0.0)]
    df = spark.createDataFrame(rows, "tid long, row_id long, itr int, vld boolean, eco double")
    assert passing(df, IterationSpec("eco", 15, 15, "sum")) == {0, 1, 2}  # valid ones only; trace 2 has no last iteration


def test_matrices(spark):
    rows = [([1.0, float("nan")], True), ([5.0, 0.1], True), ([0.0, 900.0], False)]
    df = spark.createDataFrame(rows, "cfr array<double>, vld boolean").withColumn("efo", F.col("cfr"))
    got = iterations.matrix_columns(df, ["cfr", "efo"], ["cfr"], "vld").collect()
    assert sorted(r.cfr for r in got) == [1.0, 5.0] and sorted(map(str, (r.efo for r in got))) == ["0.1", "nan"]
    assert iterations.matrix_columns(df.where("false"), ["cfr"], ["cfr"]).count() == 0


def test_positions_are_those_of_the_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("row_id"), (F.col("id") % 3).alias("tid")).repartition(5)
    got = {r.row_id: r.idx for r in iterations.with_position(df, ["row_id"], ranges=7).collect()}
    assert got == {v: k for k, v in enumerate(sorted(got), 1)} and len(got) == 1000
    assert iterations.with_position(df.where("false"), ["row_id"]).count() == 0


# ---- regions ---------------------------------------------------------------------------------------------------

RECT, OVAL = Region("r", "rectangle", 0, 0, 100, 200), Region("o", "oval", 0, 0, 100, 200)


def sized(r):
    return sorted((round(r.x1 - r.x0, 6), round(r.y1 - r.y0, 6)))


def turned(w, h, degrees):
    a = math.radians(degrees)
    return tuple((x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2)))


def test_conversions():
    assert regions.converted(RECT, "point").points == ((50.0, 100.0),)
    assert regions.converted(Region("p", "polygon", points=((0, 0), (10, 0), (10, 10), (0, 10))), "point").points == ((5.0, 5.0),)
    box = regions.converted(OVAL, "bounding_box")
    assert (box.kind, box.x0, box.y0, box.x1, box.y1, box.degrees) == ("rectangle", 0, 0, 100, 200, 0)
    least = regions.converted(Region("p", "freehand", points=turned(100, 10, 25)), "rectangle")
    assert sized(least) == [10, 100] and min(least.degrees % 90, 90 - least.degrees % 90) == pytest.approx(25)
    small = regions.converted(Region("p", "point", points=((10, 20),)), "oval", 30, 40)
    assert (small.kind, small.x0, small.y0, small.x1, small.y1) == ("oval", -5, 0, 25, 40)
    hull = regions.converted(Region("p", "polygon", points=((0, 0), (10, 0), (5, 5), (10, 10), (0, 10))), "convex_hull")
    assert hull.kind == "polygon" and len(hull.points) == 4
    line = regions.converted(Region("r", "rectangle", 0, 0, 100, 60), "line")
    assert line.kind == "line" and line.closed and set(line.points) == {(0, 0), (100, 0), (100, 60), (0, 60)}
    assert len(regions.converted(Region("l", "line", points=((0, 0), (4, 0), (4, 4))), "polygon").points) == 3
    assert regions.converted(Region("a", "angle", points=((0, 0), (1, 1), (2, 0))), "point").points == ((1, 1),)
    for region, target in ((Region("a", "angle", points=((0, 0), (1, 1), (2, 0))), "line"), (Region("l", "line", points=((0, 0), (4, 0))), "polygon"), (small, "region"), (Region("p", "point", points=((1, 1),)), "oval"), (line, "region"), (RECT, "rectangle"), (RECT, "blob")):
        with pytest.raises(ValueError):
            regions.converted(region, target)


@pytest.mark.parametrize("points", [turned(100, 10, 25), [(0, 0), (10, 0), (0, 10)], [(math.cos(t), 2 * math.sin(t)) for t in np.linspace(0, 6, 40)]])
def test_ellipses_enclose(points):
    def reach(r):
        a = math.radians(r.degrees)
        cx, cy = (r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2
        return max(math.hypot(((x - cx) * math.cos(a) + (y - cy) * math.sin(a)) / ((r.x1 - r.x0) / 2), ((y - cy) * math.cos(a) - (x - cx) * math.sin(a)) / ((r.y1 - r.y0) / 2)) for x, y in points)

    upright, least = (regions.converted(Region("p", "polygon", points=tuple(points)), t) for t in ("oval", "ellipse"))
    area = [(r.x1 - r.x0) * (r.y1 - r.y0) for r in (upright, least)]
    assert upright.degrees == 0 and reach(upright) == pytest.approx(1) and reach(least) == pytest.approx(1, abs=1e-5) and area[1] <= area[0] * (1 + 1e-5)
    if len(points) == 3:  # the least ellipse of a triangle has 4 pi / (3 sqrt 3) times its area
        assert area[1] * math.pi / 4 == pytest.approx(4 * math.pi / (3 * math.sqrt(3)) * 50, rel=1e-5)


def test_resizing(spark):
    square = Region("s", "rectangle", 0, 0, 100, 100, 30.0)
    assert (lambda r: (r.x0, r.y0, r.x1, r.y1, r.degrees))(regions.resized(square, 10)) == (-10, -10, 110, 110, 30)
    assert (lambda r: (r.x0, r.y0, r.x1, r.y1))(regions.resized(square, -10)) == (10, 10, 90, 90)
    point = regions.resized(Region("p", "point", points=((0.0, 0.0),)), 50)
    assert (point.kind, point.x0, point.y1) == ("oval", -25, 25)
    assert regions.resized(Region("p", "polygon", points=((0, 0), (100, 0), (100, 50), (0, 50))), 10).points == ((-10, -10), (110, -10), (110, 60), (-10, 60))
    line = Region("l", "line", points=((0.0, 0.0), (10.0, 0.0)))
    band, ring = regions.resized(line, 2), regions.resized(regions.converted(Region("r", "rectangle", 0, 0, 100, 60), "line"), 5)
    at = spark.createDataFrame([(-1.9, 0.0), (-2.1, 0.0), (5.0, 1.9), (5.0, 2.1), (11.4, 1.4), (11.5, 1.5)], "x double, y double")
    assert [r.h for r in at.select(regions.holds(band, F.col("x"), F.col("y")).alias("h")).collect()] == [True, False, True, False, True, False]
    at = spark.createDataFrame([(0.0, 30.0), (50.0, 30.0), (200.0, 30.0), (0.0, 58.0)], "x double, y double")
    assert [r.h for r in at.select(regions.holds(ring, F.col("x"), F.col("y")).alias("h")).collect()] == [True, False, False, True]
    for region, d in ((square, -50), (line, -1), (Region("p", "point", points=((0, 0),)), -1), (Region("a", "angle", points=((0, 0), (1, 1), (2, 0))), 1), (square, 0), (Region("p", "polygon", points=((0, 0), (100, 0), (100, 50))), -25), (band, 1)):
        with pytest.raises(ValueError):
            regions.resized(region, d)


def test_bands_are_written_and_read(spark, tmp_path):
    made = regions.resized(regions.converted(RECT, "line"), 5.0)
    regions.write_regions(spark, [made], str(tmp_path / "b"))
    assert regions.read_regions(spark, str(tmp_path / "b")) == [made]


def test_snapping(spark):
    px = spark.createDataFrame([(12, 10, 3.0), (14, 10, 1.0), (12, 12, 4.0)], "ix long, iy long, v double")
    rows = [(1, 11.0, 10.0, 0.0, 0.0), (2, 90.0, 90.0, 0.0, 0.0), (3, 11.0, 10.0, 1.0, 0.0)]
    got = {r.id: (r.col, r.row) for r in regions.snapped(px, spark.createDataFrame(rows, "id long, col double, row double, dx double, dy double")).collect()}
    assert got == {1: (12.25, 11.0), 2: (90.0, 90.0), 3: (11.0, 11.0)}  # the mean by mass; an empty square; across the x axis only


# ---- renders, edges, levels ------------------------------------------------------------------------------------


def test_edges(spark):
    one = spark.createDataFrame([(0.0, 20.0), (0.0, 19.0), (3.0, 3.0)], "lo double, hi double")
    assert [list(r[0]) for r in one.select(renders.edges(F.col("lo"), F.col("hi"), 10.0)).collect()] == [[0, 10, 20, 30], [0, 10, 20], [3, 13]]
    with pytest.raises(ValueError):
        renders.edges(F.lit(0.0), F.lit(1.0), 0.0)


def test_rendered_rows_have_mass_one_each(spark):
    p = spark.createDataFrame([(1, 0.3, 0.2, 2.0, 8.0), (2, 50.0, 50.0, 0.0, 0.0), (3, float("nan"), 0.0, 1.0, 1.0)], "id long, x double, y double, sx double, sy double")
    got = renders.precision_render(p, 0.5, F.col("sx"), F.col("sy")).collect()
    wide = [(r.ix * 0.5 + 0.25, r.iy * 0.5 + 0.25, r.v) for r in got if r.ix < 50]
    assert sum(v for _, _, v in wide) == pytest.approx(1, abs=1e-9) and sum(r.v for r in got) == pytest.approx(2, abs=1e-9)
    mx, my = (sum(w[i] * w[2] for w in wide) for i in (0, 1))
    assert (mx, my) == pytest.approx((0.3, 0.2), abs=0.05)
    assert math.sqrt(sum(v * (x - mx) ** 2 for x, _, v in wide)) == pytest.approx(2, rel=0.02)
    assert math.sqrt(sum(v * (y - my) ** 2 for _, y, v in wide)) == pytest.approx(8, rel=0.02)


def test_a_turn_lifts_what_lies_to_the_right(spark):
    c, r = renders.moved_pixels(F.lit(15.0), F.lit(10.0), 90.0, 1.0, (0.0, 0.0), (10.0, 10.0))
    assert spark.range(1).select(F.round(c, 9), F.round(r, 9)).first() == (10.0, 5.0)


def test_contrast(spark):
    values = [0.0] * 5000 + [10.0 + k % 100 for k in range(5000)] + [256.0]
    df = spark.createDataFrame([(v,) for v in values], "n double")
    assert tuple(renders.contrast_levels(df).first()) == (10.0, 109.0)  # the background is too common, one pixel too rare
    assert tuple(renders.contrast_levels(df.where("n = 0")).first()) == (0.0, 1.0)
    assert renders.contrast_levels(df.limit(9)).count() == 0


def test_units_and_tilts(spark):
    df = spark.createDataFrame([(0.01, False), (0.0, False), (-1.0, False), (5.0, False), (60.0, False), (5.0, True), (None, False)], "step double, whole boolean")
    assert [r[0] for r in df.select(sets.time_unit(F.col("step"), F.col("whole"))).collect()] == ["s", None, None, "ms", None, None, None]
    tilts = spark.createDataFrame([(10.0, 10.0), (0.0, 10.0), (5.0, 10.0), (-3.0, 10.0), (30.0, 10.0), (1.0, 0.0)], "e double, w double").select(G.tilt(F.col("e"), F.col("w")).alias("t")).collect()
    assert [None if r.t is None else round(r.t, 6) for r in tilts] == [0, 90, 30, 90, 0, None]


def test_profiles_have_all_bins_and_mirrored_ends(spark):
    counts = {0: 4, 1: 0, 2: 0, 3: 2, 4: 1, 5: 7}
    df = spark.createDataFrame([(10.0 * k + 1,) for k, n in counts.items() for _ in range(n)], "y double")
    got = {r.k: r.smooth for r in paths.detrended(paths.profile_bins(df, "y", 10.0), 1.5, 0.0).collect()}
    v, r = np.array(list(counts.values()), float), int(4 * 1.5 + 0.5)
    g = np.exp(-((np.arange(-r, r + 1) / 1.5) ** 2) / 2)
    want = np.convolve(np.pad(v, r, mode="symmetric"), g / g.sum(), mode="valid")
    assert sorted(got) == list(range(6)) and np.allclose([got[k] for k in range(6)], want)
    flat = paths.detrended(paths.profile_bins(df, "y", 10.0), 0.0, 0.0).agg(F.sum("detrended")).first()[0]
    assert abs(flat) < 1e-9


def test_pooled_values_add_up_in_row_order(spark):
    values = [0.3, 0.2, 0.1]  # from the last row on
    rows = [(1, 1, 4 - k, 4 - k, True, v, 4) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "tid long, isl long, row_id long, itr int, vld boolean, eco double, top int").coalesce(1)
    total = (0.1 + 0.2) + 0.3
    assert total != (0.3 + 0.2) + 0.1
    assert {r.v for r in df.select(iterations.localization_value("eco", "sum").alias("v")).collect()} == {total}
