import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.engine import Engine
from tracelake.operators import overlay, paths, resampling, spatial
from tracelake.operators.filters import Spec
from tracelake.plans import iteration


def test_selectors():
    assert [iteration.parse_selector(t) for t in ("Last", "2", "3rd", "iteration 1", "sum")] == ["last", 1, 2, 0, "sum"]
    assert iteration.selectors(2) == ["last", "all", "1", "2", "sum", "average"]
    assert iteration.parse_numbers("1-3, 7,2") == [1, 2, 3, 7]
    for bad in ("0", "x"):
        with pytest.raises(ValueError):
            iteration.parse_selector(bad)


def test_photon_iterations():
    steps = iteration.sequence_steps(json.dumps([{"scale": 2}, {"scale": 1, "pattern": "xy"}, {"scale": 1, "pattern": "xy"}, {"scale": 1, "pattern": "z"}]))
    assert iteration.photon_iterations(steps, 4, 3) == [2, 3]
    assert iteration.photon_iterations(None, 4, 3) == [2, 3] and iteration.photon_iterations(None, 4, 2) == [3] and iteration.photon_iterations(None, 0, 2) == []
    assert iteration.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 4}}) == {"a": {"b": 1, "c": 4}, "d": 3}


def test_defaults():
    assert overlay.density_method(1000, 1e6, 5.0) == "exact" and overlay.density_method(10**8, 1e6, 500.0) == "voxel"
    assert [overlay.smallest_type(n) for n in (255, 256, 70_000)] == ["uint8", "uint16", "uint32"]
    assert overlay.preview_rows(60) == [*range(10), 10, 20, 50, 59] and overlay.preview_rows(0) == []


def test_cells_on_disk_prune(tmp_path, spark):
    df = spark.createDataFrame([(i, float(i), float(i % 97)) for i in range(5000)], "id long, x double, y double")
    overlay.write_cells(df, str(tmp_path / "cells"), 10.0, 16)
    got = overlay.box_query(spark.read.parquet(str(tmp_path / "cells")), 100, 5, 400, 50, 10.0)
    assert {r.id for r in got.collect()} == {i for i in range(5000) if 100 <= i <= 400 and 5 <= i % 97 <= 50}


def test_straight_line_stays_straight(spark):
    line = np.stack([np.arange(0, 101, 2.0), np.zeros(51), np.zeros(51)], 1)
    df = spark.createDataFrame([(i, float(i), 3.0, 0.0) for i in range(100)] + [(500, 50.0, 40.0, 0.0)], "id long, x double, y double, z double")
    rows = paths.straightened(df, line, 5.0, 10.0).collect()
    assert sum(r.n for r in rows) == 100 and {r.s for r in rows} == set(range(10))


def test_merged_sites_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 60, (80, 2))
    site = list(range(80))
    pairs = sorted((math.dist(p[i], p[j]), i, j) for i in range(80) for j in range(i + 1, 80))
    for d, i, j in pairs:
        if d > 6:
            break
        a, b = sorted((site[i], site[j]))
        members = [k for k in range(80) if site[k] in (a, b)]
        if a != b and max(math.dist(p[u], p[v]) for u in members for v in members) <= 9:
            site = [a if s == b else s for s in site]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    assert {r.id: r.site for r in resampling.merged_sites(df, 6.0, 9.0).collect()} == dict(enumerate(site))
    with pytest.raises(ValueError):
        resampling.merged_sites(df, 60.0, 9.0, most=10)


def test_bootstrap_and_permutation(spark):
    df = spark.range(2000).select("id", F.pmod("id", F.lit(100)).alias("c"), (F.col("id") % 7).cast("double").alias("v"))
    r = resampling.bootstrap_mean(df, "c", "v").first()
    assert r.low < r["mean"] < r.high and r.high - r.low < 1
    p = resampling.permuted(df, "v", ["c"], 3)
    assert sorted(x.v for x in p.where("c = 5").collect()) == sorted(x.v for x in df.where("c = 5").collect())


def test_pairs_beyond_chance(spark):
    u = lambda key, k: resampling.uniform(key, k)
    cluster = F.floor(F.col("id") / 20)
    df = spark.range(1280).select("id", *((u(cluster, k) * 5000 + u(F.col("id"), 2 + k) * 6).alias(a) for k, a in enumerate("xy")))
    e = resampling.excess(spatial.pair_profile(df, 40.0, 4.0), resampling.envelope(df, 400.0, 40.0, 4.0, 5), 0, 3).first()
    assert e.ratio > 5 and e.z > 5


def test_facade(tmp_path, spark):
    rows = "\n".join(json.dumps({"row_id": i, "tid": i % 4, "itr": i // 4 % 2, "vld": True, "tim": float(i), "loc": [i * 1e-9, 0, 0], "eco": i}) for i in range(40))
    (tmp_path / "a.json").write_text(rows)
    e = Engine(spark, str(tmp_path / "journal"))
    e.open("a", str(tmp_path / "a.json"))
    assert e.view("a").count() == 20 and spark.sql("SELECT count(*) AS n FROM a").first().n == 40
    e.set_filters("a", [Spec("eco", "loc", 10), Spec("siz", "loc", 1)])
    assert e.column("a", "eco").count() == 16 and e.positions("a", "um").agg(F.max("x")).first()[0] == pytest.approx(0.039)
    e.save("a", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 16
    e.reset("a")
    assert e.view("a").count() == 20 and spark.read.json(str(tmp_path / "journal")).count() == 3
    with pytest.raises(ValueError):
        e.add("a", spark.range(1))


def test_merged_sites_go_on_from_tile_to_tile(spark, monkeypatch):
    """Larger components than a tile, equal positions, ties, and points without a place."""
    rng = np.random.default_rng(5)
    p = np.concatenate([np.round(rng.uniform(0, 30, (500, 2)) * 2) / 2, rng.uniform(0, 30, (200, 2))])
    site = np.arange(700)
    pairs = sorted((float(np.hypot(*(p[i] - p[j]))), i, j) for i in range(700) for j in range(i + 1, 700) if abs(p[i] - p[j]).max() <= 2)
    for d, i, j in pairs:
        a, b = sorted((site[i], site[j]))
        if d <= 2 and a != b:
            m = p[(site == a) | (site == b)]
            if np.hypot(*(m[:, None] - m[None]).transpose(2, 0, 1)).max() <= 2.5:
                site[site == b] = a
    rows = [(i, *map(float, q)) for i, q in enumerate(p)] + [(900, float("nan"), 1.0), (901, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    monkeypatch.setattr(resampling, "SPOTS", 4)
    monkeypatch.setattr(resampling, "PAIRS", 300)
    got = {r.id: r.site for r in resampling.merged_sites(df, 2.0, 2.5).collect()}
    assert got == dict(enumerate(site.tolist())) | {900: 900, 901: 901}
