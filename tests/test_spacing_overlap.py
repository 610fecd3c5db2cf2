import math
import random

from pyspark.sql import functions as F

from tracelake.operators import particles, spatial


def test_every_point_has_a_kth_distance(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(60)] + [(60 + i, 1000.0 * i, -3000.0) for i in range(5)]
    want = {i: sorted(math.hypot(x - u, y - v) for j, u, v in rows if j != i)[3] for i, x, y in rows}
    df = spark.createDataFrame([*rows, (90, None, 1.0), (91, float("nan"), 1.0), (92, float("inf"), 1.0)], "id long, x double, y double")
    got = {r.id: r.d for r in spatial.kth_distance(df, 4, 3.0).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert spatial.kth_distance(df.where("id < 4"), 4, 3.0).count() == 0


def test_overlap_has_no_size_limit(spark):
    """A particle of 20,001 points, of which all but one lie far away."""
    near = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 7.9, -7.9, 1.0), (2, 1.0, 2.0, 3.0), (2, 8.1, 0.0, 0.0)], "particle long, x double, y double, z double")
    far = spark.range(20_000).select(F.lit(1).cast("long").alias("particle"), (1000.0 + F.col("id") * 20).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = particles.overlap(near.union(far), 1, 2, 1.0).first().overlap
    assert abs(got - math.exp(-14 / 4) - math.exp(-(2 * 7.9**2 + 1) / 4)) < 1e-12
