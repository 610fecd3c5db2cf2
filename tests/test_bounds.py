"""Values on bounds and edges: the same rows in whatever order sums are taken, and as the SQL says."""

import random
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from tracelake import more_queries
from tracelake.operators import binning, filters
from tracelake.operators.filters import Spec
from tracelake.queries import ORACLE_SQL, QUERIES


def test_means_on_a_bound(spark):
    """Each trace has a mean of 30, which its sum misses in some orders."""
    rng, rows = random.Random(3), []
    for tid in range(300):
        part = [round(rng.uniform(0, 60), 2) for _ in range(9)]
        part = [*part, *(round(60 - v, 2) for v in part)]
        rows += [(tid, tid * 100 + k, v) for k, v in enumerate(rng.sample(part, len(part)))]
    df = spark.createDataFrame(rows, "tid long, row_id long, eco double")
    assert df.groupBy("tid").agg(F.avg("eco").alias("m")).where("m <> 30").count()
    for spec in (Spec("eco", "mean", 30), Spec("eco", "mean", None, 30), Spec("eco", "mean", 30, 30)):
        assert filters.apply_specs(df, [spec]).count() == len(rows)
    assert not filters.apply_specs(df, [Spec("eco", "mean", 30, None, lo_inc=False)]).count()


def test_points_on_the_edge_of_a_grown_polygon(spark, tmp_path):
    key = next(k for k in range(2003) if k * 37 % 2003 == 1000)
    xs = [1150.0, 1149.9999, 1150.0001, 1850.0, 1849.9999, 1850.0001]
    rows = [(key + 2003 * n, 1, 100 * x) for n, x in enumerate(xs)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderdate", F.to_date(F.lit("2020-01-01"))).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = {r.id for r in QUERIES["resized_region"](spark, str(tmp_path)).collect()}
    assert got == {r[0] for r in con.sql(ORACLE_SQL["resized_region"]).fetchall()} and len(got) == 3 and more_queries


def test_times_of_bins_keep_their_digits(spark):
    rng = random.Random(8)
    rows = [(t, k, 1704067200 + rng.randrange(30 * 86400 * 10**6) / 10**6, round(rng.uniform(0, 9), 2)) for t in range(20) for k in range(100)]
    got = binning.photon_bins(spark.createDataFrame(rows, "tid long, row_id long, tim double, eco double"), 1e9).collect()
    for r in got:
        own = [(Fraction(t), Fraction(w)) for i, _, t, w in rows if i == r.tid]
        assert abs(r.tim - sum(t * w for t, w in own) / sum(w for _, w in own)) < 2.4e-7
