"""Queries of cells, nearest seeds, volumes and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import masks, segmentation, tracing, volumes, voronoi
from tracelake.plans.roles import view
from tracelake.queries import CLOUD, POINTS, points, query, r

# ---- Voronoi cells ---------------------------------------------------------------------------------------------


@query("voronoi_density")
def _(spark, d):
    return voronoi.density(points(spark, d))


@query("voronoi_volumes")
def _(spark, d):
    return voronoi.cells(view(spark, d, "cloud"), ["x", "y", "z"])


@query("voronoi_image")
def _(spark, d):
    return voronoi.density_image(points(spark, d), (0.0, 5000.0, 0.0, 2000.0), (100, 40))


@query("nearest_seed", f"""WITH d AS (SELECT a.id, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) AS d2, b.x, b.y FROM {CLOUD} a, {POINTS} b)
SELECT id, {r('sqrt(min(d2))', 'd')}, {r('arg_min(x, (d2, x, y))', 'x')}, {r('arg_min(y, (d2, x, y))', 'y')} FROM d GROUP BY id""")
def _(spark, d):
    near = voronoi.nearest_seed(view(spark, d, "cloud").select("id", "x", "y"), points(spark, d))
    return near.select("id", "d", F.col("seed.x").alias("x"), F.col("seed.y").alias("y"))


# ---- volumes ---------------------------------------------------------------------------------------------------


@query("volume_detections")
def _(spark, d):
    return volumes.detections(view(spark, d, "cloud"), "gaussian", {"fwhm": 60.0}, 20.0, 20.0, 0.4).select("x", "y", "z", "score")


# ---- skeleton paths --------------------------------------------------------------------------------------------


@query("skeleton_paths")
def _(spark, d):
    return tracing.path_lengths(tracing.traced(segmentation.skeleton(points(spark, d), 20.0), 3), 20.0)


@query("pixel_paths", f"""WITH RECURSIVE px AS (SELECT DISTINCT CAST(floor(x / 25) AS BIGINT) AS x, CAST(floor(y / 25) AS BIGINT) AS y FROM {POINTS} WHERE z < 40),
 s AS (SELECT a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM px a JOIN px b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)),
 g AS (SELECT px AS x, py AS y, count(*) <> 2 AS node FROM s GROUP BY 1, 2),
 w AS (SELECT s.*, s.px AS sx, s.py AS sy, s.qx AS fx, s.qy AS fy, 2 AS n, h.node AS over FROM s JOIN g ON g.x = px AND g.y = py AND g.node JOIN g h ON h.x = qx AND h.y = qy
  UNION ALL SELECT s.*, sx, sy, fx, fy, n + 1, h.node FROM w JOIN s ON s.px = w.qx AND s.py = w.qy AND NOT (s.qx = w.px AND s.qy = w.py) JOIN g h ON h.x = s.qx AND h.y = s.qy WHERE NOT w.over)
SELECT concat_ws(',', sx, sy, fx, fy) AS path, CAST(n AS BIGINT) AS pixels FROM w WHERE over AND (sx, sy, fx, fy) < (qx, qy, px, py) AND (sx <> qx OR sy <> qy)""")
def _(spark, d):
    px = points(spark, d).where("z < 40").select(F.floor(F.col("x") / 25).cast("long").alias("i_x"), F.floor(F.col("y") / 25).cast("long").alias("i_y"))
    paths = tracing.traced(px)
    open_ = paths.groupBy("path").agg(F.count(F.lit(1)).alias("pixels"), F.min_by(F.struct("i_x", "i_y"), "k").alias("a"), F.max_by(F.struct("i_x", "i_y"), "k").alias("b"))
    return open_.where("a <> b").select("path", "pixels")  # SQL walks from nodes only, and so leaves out rings


# ---- masks -----------------------------------------------------------------------------------------------------


def _mask(spark, d):
    p = points(spark, d)
    px = p.groupBy(F.floor(F.col("x") / 50).cast("long").alias("i_x"), F.floor(F.col("y") / 50).cast("long").alias("i_y")).agg(F.avg("z").alias("v"))
    return masks.runs_of(px.where("v > 55"))


_MASK = f"""m AS (SELECT CAST(floor(x / 50) AS BIGINT) AS i_x, CAST(floor(y / 50) AS BIGINT) AS i_y FROM {POINTS} GROUP BY 1, 2 HAVING avg(z) > 55),
 f AS (SELECT unnest(range(min(i_x) - 1, max(i_x) + 2)) AS i_x, min(i_y) AS lo, max(i_y) AS hi FROM m), g AS (SELECT i_x, unnest(range(lo - 1, hi + 2)) AS i_y FROM f),
 b AS (SELECT * FROM g EXCEPT SELECT * FROM m)"""


@query("mask_distances", f"""WITH {_MASK} SELECT m.i_x, m.i_y, {r('sqrt(min(pow(m.i_x - b.i_x, 2) + pow(m.i_y - b.i_y, 2)))', 'd')} FROM m, b GROUP BY m.i_x, m.i_y""")
def _(spark, d):
    return masks.distances(_mask(spark, d))


@query("mask_components", f"""WITH RECURSIVE {_MASK}, t AS (SELECT i_x AS sx, i_y AS sy, i_x, i_y FROM m UNION SELECT t.sx, t.sy, m.i_x, m.i_y FROM t JOIN m ON abs(m.i_x - t.i_x) + abs(m.i_y - t.i_y) = 1),
 l AS (SELECT i_x, i_y, min((sx, sy)) AS f FROM t GROUP BY i_x, i_y) SELECT f[1] AS x, f[2] AS y, count(*) AS pixels, min(i_y) AS lo, max(i_y) AS hi FROM l GROUP BY f""")
def _(spark, d):
    found = masks.labelled(_mask(spark, d)).groupBy("label").agg(F.sum(F.col("b") - F.col("a") + 1).alias("pixels"), F.min("i_y").alias("lo"), F.max("i_y").alias("hi"))
    place = (F.floor(F.col("label") / masks.SPAN) - masks.SPAN // 2).alias("x"), (F.col("label") % masks.SPAN - masks.SPAN // 2).alias("y")
    return found.select(*place, "pixels", "lo", "hi")


@query("cell_border")
def _(spark, d):
    p = points(spark, d)
    return masks.cells(p, border=60.0, size=20.0, smooth=40.0, close=40.0, min_area=4_000.0).of(p)
