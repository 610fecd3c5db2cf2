import json

import numpy as np
import pytest

from tracelake.operators.filters import Spec
from tracelake.sources import formats, sinks, tables


def test_sniffing(tmp_path, spark):
    with open(tmp_path / "a.csv", "wb") as f:
        np.save(f, np.zeros(3))
    assert formats.resolve(spark, str(tmp_path / "a.csv")) == ("npy", "named csv, but it holds npy")
    assert formats.sniff(b"x,y\n1,2\n") == "csv" and formats.sniff(b' [{"x": 1}]') == "json"
    assert formats.sniff(b"\x00\x01\x02") is None and formats.sniff("é".encode() * 10 + b"\xc3") == "text"


def test_json_records_and_vectors(tmp_path, spark):
    rows = [{"itr": i, "tid": 7, "vld": True, "tim": i / 10, "loc": [1e-9 * i, 2e-9, 0.0], "dcr": [0.2, 0.8], "row_id": i} for i in range(3)]
    for name, text in (("array.json", json.dumps(rows)), ("wrapped.json", json.dumps({"mfx": rows})), ("lines.json", "\n".join(map(json.dumps, rows)))):
        (tmp_path / name).write_text(text)
        df = tables.read_any(spark, str(tmp_path / name))
        assert tables.is_record_schema(df)
        got = tables.canonical(df).orderBy("row_id").collect()
        assert [r.x for r in got] == pytest.approx([0, 1, 2]) and got[0].dcr_1 == 0.8 and got[0].tid == 7


def test_csv_roles_and_units(tmp_path, spark):
    (tmp_path / "t.csv").write_text("row_id;X (um);Y (um);photons\n0;1.5;2;10\n1;3;4;20\n")
    df = tables.read_any(spark, str(tmp_path / "t.csv"))
    got = tables.canonical(df, z_scale=0.7).orderBy("row_id").collect()
    assert [(r.x, r.y, r.z, r.tid, r.photons) for r in got] == [(1500.0, 2000.0, 0.0, 1, 10), (3000.0, 4000.0, 0.0, 2, 20)]
    p = tables.column_profile(df, "photons", "row_id").first()
    assert (p.n, p.distinct, p.whole, p.step, p.rising) == (2, 2, True, 10.0, 1.0)
    assert tables.guess_unit(5e-5) == "m" and tables.guess_unit(50) == "um" and tables.guess_unit(5000) == "nm"
    with pytest.raises(ValueError):
        tables.canonical(df.drop("row_id"))


def test_numpy_source(tmp_path, spark):
    a = np.zeros(10, dtype=[("tid", "<i4"), ("vld", "?"), ("loc", "<f8", (3,))])
    a["tid"], a["loc"] = np.arange(10), np.arange(30).reshape(10, 3)
    np.save(tmp_path / "a.npy", a)
    spark.dataSource.register(tables.NpySource)
    df = spark.read.format("npy").option("rowsPerPartition", 4).load(str(tmp_path / "a.npy"))
    assert df.rdd.getNumPartitions() == 3
    assert [(r.row_id, r.tid, r.loc_z) for r in df.orderBy("row_id").collect()] == [(i, i, 3.0 * i + 2) for i in range(10)]
    assert tables.read_any(spark, str(tmp_path / "a.npy")).count() == 10


def test_nested_iterations(spark):
    df = spark.createDataFrame([(0, 5, [1.0, 2.0]), (1, 5, [3.0, 4.0])], "row_id long, tid long, efo array<double>")
    assert [(r.loc_row, r.itr, r.efo) for r in tables.unnested(df).orderBy("row_id").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_recipe_round_trip(tmp_path, spark):
    df = spark.createDataFrame([(i, i % 3, float(i), 1.0) for i in range(9)], "row_id long, tid long, v double, z double")
    specs = [Spec("v", "mean", 3.5, None), Spec("gone", "loc", 1)]
    sinks.write_recipe(spark, str(tmp_path / "r"), specs, z_scale=0.5)
    recipe = sinks.read_recipe(spark, str(tmp_path / "r"))
    assert recipe["filters"] == specs
    got = sinks.replay(df, recipe).collect()
    assert {r.tid for r in got} == {1, 2} and got[0].z == 0.5
    assert sinks.snapshot(df, specs[:1], flag=True).where("ftr").count() == 6
    for fmt in ("csv", "json", "parquet"):
        sinks.write_table(df, str(tmp_path / fmt), fmt, names={"row_id": "row_id", "v": "x nm"}, sep="tab")
        assert spark.read.format(fmt).options(header=True, sep="\t", inferSchema=True).load(str(tmp_path / fmt)).count() == 9
    sinks.append_journal(spark, str(tmp_path / "journal"), "filter", {"n": 1})
    sinks.append_journal(spark, str(tmp_path / "journal"), "filter", {"n": 2})
    assert spark.read.json(str(tmp_path / "journal")).count() == 2
