"""Matrices, region records, thinning, and sets that are written and read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import matrices as M
from tracelake.operators import iterations, regions, renders, segmentation
from tracelake.operators.iterations import IterationSpec
from tracelake.operators.regions import Region
from tracelake.sources import sets


def test_rotations():
    rng = np.random.default_rng(1)
    for a, b in [*rng.normal(size=(20, 2, 3)), ((1, 0, 0), (-1, 0, 0)), ((0, 1, 0), (0, 1, 0))]:
        m = M.rotation_between(a, b)
        assert np.allclose(m @ (np.asarray(a) / np.linalg.norm(a)), np.asarray(b) / np.linalg.norm(b)) and np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) > 0
    assert M.resolved(None) is None and M.resolved({"other": 1}) is None
    assert np.allclose(M.resolved({"degrees": 90, "shift": (1, 2)}) @ [1, 0, 0, 1], [1, 3, 0, 1])
    assert np.allclose(M.resolved({"matrix": [[1, 0, 5], [0, 1, 6], [0, 0, 1]]})[:2, 3], [5, 6])


def test_regions_are_written_and_read(spark, tmp_path):
    made = [Region("r", "rectangle", 0, 0, 4, 2, 30.0), Region("o", "oval", -1, -1, 1, 1), Region("p", "polygon", points=((0.0, 0.0), (2.0, 0.0), (1.0, 2.0)))]
    regions.write_regions(spark, made, str(tmp_path / "r"))
    assert sorted(regions.read_regions(spark, str(tmp_path / "r")), key=lambda r: r.name) == sorted(made, key=lambda r: r.name)
    regions.write_regions(spark, [Region("x", "blob")], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        regions.read_regions(spark, str(tmp_path / "x"))
    assert len(regions.outline(made[1], 16)) == 16 and math.isclose(max(x for x, _ in regions.outline(made[1], 16)), 1)
    assert regions.converted(made[2], "bounding_box") == Region("p", "rectangle", 0.0, 0.0, 2.0, 2.0)
    assert regions.converted(made[0], "line").points and regions.converted(made[2], "polygon").points == made[2].points
    assert regions.resized(made[2], 1.0).points == ((-1.0, -1.0), (3.0, -1.0), (1.0, 3.0))  # scaled about the middle of the box
    with pytest.raises(ValueError):
        regions.resized(made[1], -2)
    with pytest.raises(ValueError):
        regions.crop_specs(made[0])


def test_erf(spark):
    xs = [i / 7 for i in range(-30, 31)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", renders.erf(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erf(r.x)) < 2e-7 for r in got)
    assert renders.voxel_size((100, 100, 10), 500, (5, 10, 20)) == 10 and renders.voxel_size((1e6, 1e6), 10, (5, 10)) == 10


def test_rendered_mass_is_kept(spark):
    p = spark.createDataFrame([(i, 13.7 * i, 5.1 * i) for i in range(50)], "id long, x double, y double")
    total = renders.precision_render(p, 10.0, F.lit(12.0), F.lit(8.0)).agg(F.sum("v")).first()[0]
    assert total == pytest.approx(50, abs=1e-9)  # of any reach: each row is scaled to one


def test_thinning():
    bar = np.zeros((20, 40), dtype=bool)
    bar[8:13, 5:35] = True
    thin = segmentation.thinned(bar)
    assert thin.sum() <= 32 and thin[10].sum() >= 24 and not (thin & ~bar).any()
    ring = np.hypot(*np.mgrid[-12:13, -12:13])
    thin = segmentation.thinned((ring < 11) & (ring > 5))
    assert 30 <= thin.sum() <= 60 and not thin[12, 12]
    assert not segmentation.thinned(np.zeros((4, 4), dtype=bool)).any()


def test_iteration_specs_report_what_they_lack(spark):
    rows = [(1, k, k % 3, True, float(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "tid long, row_id long, itr int, vld boolean, cfr double")
    kept, missing = iterations.apply_iteration_specs(df, [IterationSpec("cfr", 5, None), IterationSpec("nothing", 1)])
    assert missing == ["nothing"] and {r.row_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8}
    assert iterations.resolved_iteration(IterationSpec("cfr"), {"cfr": 1}) == "effective" and iterations.resolved_iteration(IterationSpec("eco")) == "last"
    assert iterations.apply_iteration_specs(df.where("false"), [IterationSpec("cfr", 5)])[0].count() == 0


def test_sets(spark, tmp_path):
    p = spark.createDataFrame([(i, i % 3, float(i), float(i * i), 1.0) for i in range(12)], "id long, tid long, x double, y double, z double")
    sets.write_particles(sets.particle_set(p), str(tmp_path / "p"))
    back = sets.read_particles(spark, str(tmp_path / "p"))
    assert back.count() == 12 and back.groupBy("particle").agg(F.sum("x").alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-9
    v = sets.vectors(p, {"loc": ["x", "y", "z"]})
    assert sets.flattened(v, "loc", "xyz").columns == ["id", "tid", "loc_x", "loc_y", "loc_z"]
    with pytest.raises(Exception, match="must have 2 parts"):
        sets.flattened(v, "loc", "xy").collect()
    assert sets.fields(v) == [("id", "bigint"), ("tid", "bigint"), ("loc[]", "double")]
    assert sets.plot_columns(p) == ["id", "tid", "x", "y", "z"]
    with pytest.raises(ValueError):
        sets.require(p, "efo")
    assert sets.flat_table(p.drop("z")).first().z_factor == 1.0
