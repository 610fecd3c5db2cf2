"""The engine's operators as named queries over the driver tables, each with the same result in ANSI SQL.

Floats are rounded on both sides, because sums come in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import geometry as G
from tracelake.functions.aggregates import TRACE_AGGREGATES, trace_aggregate
from tracelake.operators import binning, channels, filters, graph, histogram, models, overlay, particles, paths, resampling, segmentation, selection, spatial, traces
from tracelake.operators.filters import Spec, TimeWindow
from tracelake.plans.roles import sql, view
from tracelake.sources import sinks, tables
from tracelake.streaming import traces as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Keeps values that end in 5 at the fifth digit from being rounded either way.
SHIFT = 3.3e-7


def query(name: str, text: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if text is not None:
            ORACLE_SQL[name] = text
        return f

    return add


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    cols = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + SHIFT, digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)) or isinstance(field.dataType, T.DecimalType):
            c = c.cast("long")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def r(x: str, name: str) -> str:
    return f"round(CAST({x} AS double) + {SHIFT:.9f}, 4) + 0.0 AS {name}"


def on_bounds(x: str, lo: float, hi: float) -> str:
    """A mean between bounds; one within a share of ``ON_BOUND`` of a bound is on it, in whatever order it was summed."""
    return f"{x} >= {lo - lo * filters.ON_BOUND!r}::DOUBLE AND {x} <= {hi + hi * filters.ON_BOUND!r}::DOUBLE"


STREAM, LADDER, ITER, POINTS, CLOUD = map(sql, ("trace_stream", "ladder", "iter_table", "points", "cloud"))
ISLANDS = f"""isl AS (SELECT *, sum(nw) OVER (PARTITION BY tid ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS isl FROM (
  SELECT *, CASE WHEN itr > lag(itr) OVER (PARTITION BY tid ORDER BY row_id) THEN 0 ELSE 1 END AS nw FROM {STREAM}))"""


def stream(spark, d):
    return view(spark, d, "trace_stream")


def points(spark, d):
    return view(spark, d, "points")


# ---- selection -------------------------------------------------------------------------------------------------


@query("trace_filter_hist", f"""
WITH s AS (SELECT *, avg(eco) OVER (PARTITION BY tid) AS m FROM {STREAM} WHERE vld), f AS (SELECT eco FROM s WHERE {on_bounds('m', 25, 60)}),
q AS (SELECT min(eco) lo, max(eco) hi, count(*) n, quantile_cont(eco, 0.75) - quantile_cont(eco, 0.25) AS iqr FROM f),
w AS (SELECT lo, hi, least(greatest(ceil((hi - lo) / (2 * iqr / cbrt(n))), 1), 4096) AS nb FROM q)
SELECT CAST(least(floor((eco - lo) / ((hi - lo) / nb)), nb - 1) AS BIGINT) AS bin, count(*) AS n FROM f, w GROUP BY 1""")
def _(spark, d):
    kept = filters.apply_specs(stream(spark, d).where("vld"), [Spec("eco", "mean", 25, 60)])
    return histogram.histogram(kept, "eco").select("bin", "n")


@query("last_valid_rows", f"SELECT tid, row_id, CAST(itr AS BIGINT) AS itr, {r('eco', 'eco')} FROM {STREAM} WHERE vld AND itr = (SELECT max(itr) FROM {STREAM} WHERE vld)")
def _(spark, d):
    return selection.last_valid(stream(spark, d)).select("tid", "row_id", "itr", "eco")


@query("loc_id_groups", f"WITH {ISLANDS} SELECT tid, CAST(isl AS BIGINT) AS isl, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM isl GROUP BY tid, isl")
def _(spark, d):
    return selection.with_islands(stream(spark, d)).groupBy("tid", "isl").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


for _how, _agg in (("sum", "sum"), ("average", "avg")):

    @query(f"pooled_{_how}", f"WITH {ISLANDS} SELECT tid, CAST(isl AS BIGINT) AS isl, {r(f'{_agg}(eco)', 'pooled')} FROM isl GROUP BY tid, isl")
    def _(spark, d, how=_how):
        return selection.pooled(selection.with_islands(stream(spark, d)), "eco", how)


@query("broadcast_last", f"""WITH {ISLANDS}, t AS (SELECT max(itr) AS top FROM isl WHERE vld)
SELECT row_id, {r('max(CASE WHEN vld AND itr = top THEN eco END) OVER (PARTITION BY tid, isl)', 'bc')} FROM isl, t""")
def _(spark, d):
    return selection.broadcast_last(stream(spark, d), "eco").select("row_id", "bc")


@query("value_at_iteration", f"""WITH {ISLANDS}
SELECT row_id, {r("first_value(eco) OVER (PARTITION BY tid, isl ORDER BY CASE WHEN itr = 1 THEN 0 ELSE 1 END, row_id DESC)", 'v')},
 CAST(max(CASE WHEN itr = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tid, isl) AS BIGINT) AS has FROM isl""")
def _(spark, d):
    out = selection.value_at_iteration(stream(spark, d), "eco", 1)
    w = selection.Window.partitionBy("tid", "isl")
    has = F.max(F.when(F.col("itr") == 1, 1).otherwise(0)).over(w)
    first = F.max_by("eco", "row_id").over(w)
    return out.select("row_id", F.when(has == 1, F.col("at_itr")).otherwise(first).alias("v"), has.alias("has"))


@query("effective_iteration", f"SELECT CAST(itr AS BIGINT) AS itr FROM (SELECT itr, sum(abs(eco)) AS s FROM {STREAM} WHERE vld GROUP BY itr ORDER BY s DESC, itr LIMIT 1)")
def _(spark, d):
    return selection.effective_iteration(stream(spark, d), "eco")


@query("iteration_signal", f"SELECT CAST(itr AS BIGINT) AS itr, {r('sum(abs(eco))', 'signal')}, bool_or(eco <> 0) AS present FROM {LADDER} WHERE vld GROUP BY itr")
def _(spark, d):
    return selection.iteration_signal(view(spark, d, "ladder"), "eco")


@query("derived_columns", f"""
WITH s AS (SELECT *, lag(tim) OVER w AS pt, lag(eco) OVER w AS pe FROM {STREAM} WINDOW w AS (PARTITION BY tid ORDER BY row_id)),
t AS (SELECT *, coalesce(tim - pt, 0) AS dt, coalesce(abs(eco - pe), 0) AS dst FROM s)
SELECT row_id, {r('dt', 'dt')}, {r('dst', 'dst')}, {r('CASE WHEN dt > 0 THEN dst / dt ELSE 0 END', 'spd')}, count(*) OVER p AS siz,
 {r('max(tim) OVER p - min(tim) OVER p', 'dur')}, {r('sum(dst) OVER p', 'len')}, {r('tim - min(tim) OVER p', 'tim_trace')} FROM t WINDOW p AS (PARTITION BY tid)""")
def _(spark, d):
    return selection.derived(stream(spark, d), ["eco"]).select("row_id", "dt", "dst", "spd", "siz", "dur", "len", "tim_trace")


@query("derived_last", f"""
WITH v AS (SELECT * FROM {STREAM} WHERE vld AND itr = (SELECT max(itr) FROM {STREAM} WHERE vld))
SELECT row_id, {r('coalesce(tim - lag(tim) OVER (PARTITION BY tid ORDER BY row_id), 0)', 'dt')}, count(*) OVER (PARTITION BY tid) AS siz FROM v""")
def _(spark, d):
    return selection.derived(selection.last_valid(stream(spark, d)), ["eco"]).select("row_id", "dt", "siz")


@query("final_flags", f"WITH {ISLANDS} SELECT row_id, row_number() OVER (PARTITION BY tid, isl ORDER BY row_id DESC) = 1 AS fnl FROM isl")
def _(spark, d):
    return selection.final_flags(stream(spark, d)).select("row_id", "fnl")


@query("event_ids", f"SELECT row_id, CAST(coalesce(sum(CASE WHEN itr = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS event FROM {STREAM}")
def _(spark, d):
    return selection.event_ids(stream(spark, d), F.col("itr") == 4).select("row_id", "event")


@query("dense_tids", f"SELECT channel, tid, CAST(dense_rank() OVER (ORDER BY channel, tid) - 1 AS BIGINT) AS new_tid FROM (SELECT DISTINCT CAST(itr AS BIGINT) AS channel, tid FROM {STREAM})")
def _(spark, d):
    return selection.dense_tids(stream(spark, d).withColumn("channel", F.col("itr").cast("long")))


# ---- aggregates ------------------------------------------------------------------------------------------------

_SQL_AGG = {
    "mean": "avg(eco)", "median": "quantile_cont(eco, 0.5)", "min": "min(eco)", "max": "max(eco)", "first": "arg_min(eco, row_id)",
    "last": "arg_max(eco, row_id)", "stdev": "stddev_pop(eco)", "range": "max(eco) - min(eco)",
}
for _mode in TRACE_AGGREGATES:

    @query(f"trace_{_mode}", f"SELECT tid, {r(_SQL_AGG[_mode], 'v')} FROM {STREAM} GROUP BY tid")
    def _(spark, d, mode=_mode):
        return stream(spark, d).groupBy("tid").agg(trace_aggregate(mode, "eco").alias("v"))


@query("weighted_group_mean", f"SELECT tid, {r('sum(dcr * eco) / sum(eco)', 'wmean')} FROM {ITER} WHERE eco > 0 GROUP BY tid")
def _(spark, d):
    return channels.group_weighted_mean(view(spark, d, "iter_table"), "dcr", "eco", ["tid"])


@query("precision_per_trace", f"SELECT tid, count(*) AS n, {r('stddev_samp(x)', 'sd_x')}, {r('stddev_samp(y)', 'sd_y')}, {r('sqrt((var_samp(x) + var_samp(y)) / 2)', 'sigma_r')} FROM {POINTS} GROUP BY tid HAVING count(*) >= 5")
def _(spark, d):
    return traces.precision(points(spark, d), ["x", "y"])


@query("precision_summary", f"""WITH p AS (SELECT count(*) AS n, sqrt((var_samp(x) + var_samp(y)) / 2) AS s FROM {POINTS} GROUP BY tid HAVING count(*) >= 5)
SELECT count(*) AS traces, {r('quantile_cont(s, 0.5)', 'median')}, {r('avg(s)', 'mean')}, {r('sum(s * 2 * (n - 1)) / sum(2 * (n - 1))', 'weighted')} FROM p""")
def _(spark, d):
    return traces.precision_summary(traces.precision(points(spark, d), ["x", "y"]))


@query("crlb_excess", f"""WITH c AS (SELECT tid, eco, efo / 1000 AS m, CASE WHEN fbg > 0 THEN eco / fbg ELSE 1e9 END AS sbr FROM {ITER} WHERE eco > 0),
b AS (SELECT *, 150 / (4 * sqrt(eco)) * sqrt((1 + 1 / sbr) * (1 + 3 / (4 * sbr))) AS crb FROM c)
SELECT tid, {r('avg(crb)', 'crb')}, {r('avg(sqrt(greatest(m * m - crb * crb, 0)))', 'excess')} FROM b GROUP BY tid""")
def _(spark, d):
    df = traces.crlb(view(spark, d, "iter_table").where("eco > 0").withColumn("m", F.col("efo") / 1000), "eco", "fbg", 150.0)
    return traces.excess(df, "m", "crb").groupBy("tid").agg(F.avg("crb").alias("crb"), F.avg("excess").alias("excess"))


@query("trace_centroids", f"SELECT tid, count(*) AS n, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('stddev_samp(x) / sqrt(count(*))', 'sem_x')}, {r('stddev_samp(y) / sqrt(count(*))', 'sem_y')}, {r('min(tim)', 't0')}, {r('max(tim)', 't1')} FROM {POINTS} GROUP BY tid HAVING count(*) >= 3")
def _(spark, d):
    return traces.centroids(points(spark, d), ["x", "y"], 3)


@query("trace_table", f"""
WITH s AS (SELECT *, tim - lag(tim) OVER w AS dt, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS st FROM {POINTS} WHERE tid <> 0 WINDOW w AS (PARTITION BY tid ORDER BY id))
SELECT tid, count(*) AS n, {r('avg(x)', 'mean_x')}, {r('avg(y)', 'mean_y')}, {r('avg(dt)', 'mean_dt')}, {r('avg(CASE WHEN dt > 0 THEN st / dt END)', 'mean_speed')},
 {r('sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2))', 'diagonal')} FROM s GROUP BY tid""")
def _(spark, d):
    return traces.trace_table(points(spark, d), ["x", "y"], "id")


@query("log_sizes", f"""
WITH c AS (SELECT tid, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy FROM {POINTS} GROUP BY tid),
q AS (SELECT pow(x - cx, 2) + pow(y - cy, 2) AS d2 FROM {POINTS} p JOIN c USING (tid)), g AS (SELECT ln(d2) / 2 AS g FROM q WHERE d2 > 0),
b AS (SELECT floor(g / 0.25) AS bin, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, bin LIMIT 1)
SELECT {r('exp(avg(g))', 'geometric')}, {r('exp(quantile_cont(g, 0.5))', 'median')}, {r('exp(((SELECT bin FROM b) + 0.5) * 0.25)', 'modal')}, count(*) AS n FROM g""")
def _(spark, d):
    return traces.log_sizes(points(spark, d), ["x", "y"])


@query("bead_medians", f"SELECT tid AS gri, {r('quantile_cont(x, 0.5)', 'x')}, {r('quantile_cont(y, 0.5)', 'y')} FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY tim, id) AS k FROM {POINTS}) WHERE k <= 5 GROUP BY tid")
def _(spark, d):
    return channels.bead_medians(points(spark, d).withColumnRenamed("tid", "gri").withColumnRenamed("id", "row_id"), 5)


@query("bead_drift", f"""WITH m AS (SELECT tid, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, min(tim) AS t FROM {POINTS} GROUP BY tid)
SELECT id, {r('x - mx', 'x')}, {r('y - my', 'y')}, {r('tim - t', 'tim')} FROM {POINTS} p JOIN m USING (tid)""")
def _(spark, d):
    return channels.bead_drift(points(spark, d).withColumnRenamed("tid", "gri")).select("id", "x", "y", "tim")


@query("acquisition_groups", f"""WITH t AS (SELECT tid, itr, avg(eco) AS m FROM {STREAM} GROUP BY tid, itr)
SELECT CAST(coalesce(itr, -1) AS BIGINT) AS grp, count(*) AS n, {r('quantile_cont(m, 0.5)', 'median')}, {r('max(m) - min(m)', 'span')} FROM t GROUP BY GROUPING SETS ((itr), ())""")
def _(spark, d):
    t = stream(spark, d).groupBy("tid", "itr").agg(F.avg("eco").alias("m"))
    agg = [F.count(F.lit(1)).alias("n"), F.percentile("m", 0.5).alias("median"), (F.max("m") - F.min("m")).alias("span")]
    return t.groupingSets([["itr"], []], "itr").agg(*agg).select(F.coalesce("itr", F.lit(-1)).alias("grp"), "n", "median", "span")


@query("photons_per_event", f"WITH {ISLANDS} SELECT tid, CAST(isl AS BIGINT) AS isl, {r('sum(CASE WHEN itr IN (1, 2) THEN eco END)', 'photons')} FROM isl GROUP BY tid, isl")
def _(spark, d):
    return binning.event_photons(selection.with_islands(stream(spark, d)), [1, 2])


@query("photon_bins", f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY row_id) AS k FROM {STREAM}),
f AS (SELECT tid, k, eco AS acc, CAST(0 AS BIGINT) AS chunk FROM o WHERE k = 1
 UNION ALL SELECT o.tid, o.k, CASE WHEN f.acc >= 500 THEN 0 ELSE f.acc END + o.eco, f.chunk + CASE WHEN f.acc >= 500 THEN 1 ELSE 0 END FROM f JOIN o ON o.tid = f.tid AND o.k = f.k + 1),
g AS (SELECT o.*, f.chunk, min(tim) OVER (PARTITION BY o.tid, f.chunk) AS t0 FROM f JOIN o ON o.tid = f.tid AND o.k = f.k),
c AS (SELECT tid, chunk, count(*) AS n, sum(eco) AS photons, min(t0) + CASE WHEN sum(eco) > 0 THEN sum((tim - t0) * eco) / sum(eco) ELSE avg(tim - t0) END AS tim FROM g GROUP BY 1, 2)
SELECT tid, chunk, n, {r('photons', 'photons')}, {r('floor(tim * 100 + 0.5) / 100', 'tim')}, chunk = 0 AS bot, chunk = max(chunk) OVER (PARTITION BY tid) AS eot FROM c""")
def _(spark, d):
    return binning.photon_bins(stream(spark, d), 500.0).withColumn("tim", F.floor(F.col("tim") * 100 + 0.5) / 100)


# ---- filters and regions ---------------------------------------------------------------------------------------


@query("spec_conjunction", f"""WITH m AS (SELECT *, quantile_cont(eco, 0.5) OVER (PARTITION BY tid) AS med, max(eco) OVER (PARTITION BY tid) - min(eco) OVER (PARTITION BY tid) AS rng FROM {STREAM})
SELECT row_id, {r('eco', 'eco')} FROM m WHERE med >= 30 AND med <= 45 AND rng > 100 AND eco >= 10 AND eco < 200""")
def _(spark, d):
    specs = [Spec("eco", "median", 30, 45), Spec("eco", "range", 100, None, lo_inc=False), Spec("eco", "loc", 10, 200, hi_inc=False)]
    return filters.apply_specs(stream(spark, d), specs).select("row_id", "eco")


@query("spec_pass_count", f"""WITH m AS (SELECT *, stddev_pop(eco) OVER (PARTITION BY tid) AS sd FROM {STREAM})
SELECT count(*) FILTER (WHERE sd <= 50 AND eco >= 20) AS passed, count(*) AS total FROM m""")
def _(spark, d):
    m = filters.with_masks(stream(spark, d), [Spec("eco", "stdev", None, 50), Spec("eco", "loc", 20)])
    return m.agg(F.count_if(F.col("ok0") & F.col("ok1")).alias("passed"), F.count(F.lit(1)).alias("total"))


@query("roi_rectangle", f"""WITH p AS (SELECT id, (x - 2000) * cos(radians(30)) + (y - 900) * sin(radians(30)) AS u, (y - 900) * cos(radians(30)) - (x - 2000) * sin(radians(30)) AS v FROM {POINTS})
SELECT id FROM p WHERE abs(u) <= 800 AND abs(v) <= 300""")
def _(spark, d):
    return points(spark, d).where(G.in_rectangle(F.col("x"), F.col("y"), 1200, 600, 2800, 1200, 30)).select("id")


@query("roi_oval", f"SELECT id FROM {POINTS} WHERE pow((x - 2000) / 1000, 2) + pow((y - 1000) / 500, 2) <= 1")
def _(spark, d):
    return points(spark, d).where(G.in_oval(F.col("x"), F.col("y"), 1000, 500, 3000, 1500)).select("id")


_POLY = [(500.0, 200.0), (3500.0, 400.0), (2500.0, 1700.0), (1800.0, 700.0), (900.0, 1600.0)]
_EDGES = " UNION ALL ".join(f"SELECT {a[0]} AS vx, {a[1]} AS vy, {b[0]} AS wx, {b[1]} AS wy" for a, b in zip(_POLY, [*_POLY[1:], _POLY[0]], strict=True))


@query("roi_polygon", f"""SELECT id FROM {POINTS} p, ({_EDGES}) e WHERE (vy > y) <> (wy > y) AND x < (wx - vx) * (y - vy) / (wy - vy) + vx GROUP BY id HAVING count(*) % 2 = 1""")
def _(spark, d):
    return points(spark, d).where(G.in_polygon(F.col("x"), F.col("y"), _POLY)).select("id")


@query("roi_union_and_extrusion", f"""SELECT id, (x BETWEEN 0 AND 900 AND y BETWEEN 0 AND 900) OR pow((x - 2000) / 1000, 2) + pow((y - 1000) / 500, 2) <= 1 AS any_of,
 (x BETWEEN 500 AND 3500 AND y BETWEEN 200 AND 1800) AND (x BETWEEN 1000 AND 3000 AND z BETWEEN 20 AND 80) AS all_of FROM {POINTS}""")
def _(spark, d):
    x, y, z = map(F.col, "xyz")
    some = filters.any_of([G.in_rectangle(x, y, 0, 0, 900, 900), G.in_oval(x, y, 1000, 500, 3000, 1500)])
    every = filters.all_of([G.in_rectangle(x, y, 500, 200, 3500, 1800), G.in_rectangle(x, z, 1000, 20, 3000, 80)])
    return points(spark, d).select("id", some.alias("any_of"), every.alias("all_of"))


@query("crop_trace_complete", f"SELECT id FROM (SELECT id, avg(x) OVER (PARTITION BY tid) AS cx, avg(y) OVER (PARTITION BY tid) AS cy FROM {POINTS}) WHERE cx BETWEEN 2000 AND 2600 AND cy BETWEEN 800 AND 1100")
def _(spark, d):
    return filters.crop(points(spark, d), lambda x, y: G.in_rectangle(x, y, 2000, 800, 2600, 1100), "x", "y", True).select("id")


_T0 = 1704067200.0
_TIMES = [TimeWindow("a", _T0, _T0 + 86400), TimeWindow("b", _T0 + 86400, _T0 + 2 * 86400), TimeWindow("c", _T0 + 3 * 86400, _T0 + 5 * 86400)]


@query("time_channels", f"""SELECT row_id, CASE WHEN tim >= {_T0} AND tim < {_T0 + 86400} THEN 'a' WHEN tim >= {_T0 + 86400} AND tim <= {_T0 + 2 * 86400} THEN 'b'
 WHEN tim >= {_T0 + 3 * 86400} AND tim <= {_T0 + 5 * 86400} THEN 'c' END AS channel FROM {STREAM}""")
def _(spark, d):
    return stream(spark, d).select("row_id", filters.time_channel(F.col("tim"), _TIMES).alias("channel"))


@query("value_windows", f"SELECT row_id, CAST(CASE WHEN eco BETWEEN 0 AND 20 THEN 0 WHEN eco BETWEEN 15 AND 40 THEN 1 WHEN eco BETWEEN 50 AND 80 THEN 2 ELSE -1 END AS BIGINT) AS channel FROM {STREAM}")
def _(spark, d):
    return stream(spark, d).select("row_id", filters.value_window(F.col("eco"), [(0, 20), (15, 40), (50, 80)]).alias("channel"))


@query("stride_sample", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY tid ORDER BY row_id) - 1 AS k FROM {STREAM}) WHERE k % 7 = 0")
def _(spark, d):
    return filters.stride_sample(stream(spark, d), 7).select("row_id")


# ---- channels --------------------------------------------------------------------------------------------------


@query("attribute_channels_mean", f"SELECT tid, CAST(CASE WHEN avg(eco) BETWEEN 0 AND 35 THEN 0 WHEN avg(eco) BETWEEN 35 AND 60 THEN 1 ELSE -1 END AS BIGINT) AS channel FROM {STREAM} GROUP BY tid")
def _(spark, d):
    return channels.assign_traces(stream(spark, d), "eco", [(0, 35), (35, 60)], "mean")


@query("attribute_channels_majority", f"""
WITH l AS (SELECT tid, CASE WHEN eco BETWEEN 0 AND 20 THEN 0 WHEN eco BETWEEN 20 AND 60 THEN 1 WHEN eco BETWEEN 60 AND 100 THEN 2 ELSE -1 END AS label FROM {STREAM}),
c AS (SELECT tid, label, count(*) AS n FROM l WHERE label >= 0 GROUP BY tid, label), m AS (SELECT tid, max(n) AS best, sum(n) AS total FROM c GROUP BY tid),
w AS (SELECT c.tid, count(*) AS ties, min(label) AS label, max(best) AS best, max(total) AS total FROM c JOIN m ON c.tid = m.tid AND c.n = m.best GROUP BY c.tid)
SELECT t.tid, CAST(coalesce(CASE WHEN ties = 1 AND best / total >= 0.4 THEN label ELSE -1 END, -1) AS BIGINT) AS channel FROM (SELECT DISTINCT tid FROM l) t LEFT JOIN w ON t.tid = w.tid""")
def _(spark, d):
    return channels.assign_traces(stream(spark, d), "eco", [(0, 20), (20, 60), (60, 100)], "majority", 0.4)


_MIX = [(0.6, 25.0, 12.0), (0.4, 80.0, 30.0)]
_P = [f"{w} * exp(-pow((eco - {m}) / {s}, 2) / 2) / ({s} * sqrt(2 * pi()))" for w, m, s in _MIX]


@query("posterior_labels", f"""SELECT row_id, {r(f'({_P[0]}) / (({_P[0]}) + ({_P[1]}))', 'p0')}, CASE WHEN greatest({_P[0]}, {_P[1]}) / (({_P[0]}) + ({_P[1]})) >= 0.8 THEN CAST(CASE WHEN ({_P[0]}) >= ({_P[1]}) THEN 0 ELSE 1 END AS BIGINT) ELSE -1 END AS label
 FROM {STREAM}""")
def _(spark, d):
    v = F.col("eco")
    return stream(spark, d).select("row_id", G.responsibilities(v, _MIX)[0].alias("p0"), G.posterior_label(v, _MIX, 0.8).alias("label"))


@query("flatten_union", f"""WITH u AS (SELECT 0 AS channel, tid, row_id, eco FROM {STREAM} WHERE itr = 1 UNION ALL SELECT 1, tid, row_id, eco FROM {STREAM} WHERE itr = 2)
SELECT CAST(channel AS BIGINT) AS channel, row_id, {r('eco', 'eco')}, CAST(dense_rank() OVER (ORDER BY channel, tid) - 1 AS BIGINT) AS tid FROM u""")
def _(spark, d):
    s = stream(spark, d)
    return channels.flatten({0: s.where("itr = 1").drop("tim"), 1: s.where("itr = 2").drop("vld")}).select("channel", "row_id", "eco", "tid")


@query("reconstruct_union", f"SELECT tid, row_id, {r('eco', 'eco')} FROM {STREAM} WHERE itr IN (1, 2)")
def _(spark, d):
    s = stream(spark, d)
    return channels.reconstruct([s.where("itr = 1").drop("tim"), s.where("itr = 2").drop("vld")]).select("tid", "row_id", "eco")


@query("sigma_lookup", f"""WITH p AS (SELECT tid, sqrt((var_samp(x) + var_samp(y)) / 2) AS s FROM {POINTS} GROUP BY tid HAVING count(*) >= 8)
SELECT id, {r('coalesce(s, 5)', 'sigma')} FROM {POINTS} q LEFT JOIN p ON q.tid = p.tid""")
def _(spark, d):
    sigma = traces.precision(points(spark, d), ["x", "y"], 8).select("tid", "sigma_r")
    return points(spark, d).join(sigma, "tid", "left").select("id", F.coalesce("sigma_r", F.lit(5.0)).alias("sigma"))


@query("trace_semi_join", f"SELECT id FROM {POINTS} WHERE tid IN (SELECT tid FROM {POINTS} GROUP BY tid HAVING avg(z) > 80)")
def _(spark, d):
    p = points(spark, d)
    return p.join(p.groupBy("tid").agg(F.avg("z").alias("m")).where("m > 80"), "tid", "left_semi").select("id")


# ---- space -----------------------------------------------------------------------------------------------------


@query("local_density", f"SELECT a.id, count(*) AS den FROM {POINTS} a JOIN {POINTS} b ON b.x BETWEEN a.x - 15 AND a.x + 15 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 225 GROUP BY a.id")
def _(spark, d):
    return spatial.local_density(points(spark, d), 15.0)


@query("band_pairs", f"SELECT a.id AS a, b.id AS b, {r('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))', 'd')} FROM {POINTS} a JOIN {POINTS} b ON a.id < b.id AND b.x BETWEEN a.x - 10 AND a.x + 10 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) BETWEEN 25 AND 100")
def _(spark, d):
    return spatial.band_pairs(points(spark, d), 5.0, 10.0)


@query("pair_profile", f"""SELECT CAST(least(floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2), 9) AS BIGINT) AS bin, count(*) AS n FROM {POINTS} a JOIN {POINTS} b
 ON a.id < b.id AND b.x BETWEEN a.x - 20 AND a.x + 20 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400 GROUP BY 1""")
def _(spark, d):
    return spatial.pair_profile(points(spark, d), 20.0, 2.0)


@query("density_3d", f"SELECT a.id, count(*) AS den FROM {CLOUD} a JOIN {CLOUD} b ON b.x BETWEEN a.x - 60 AND a.x + 60 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 3600 GROUP BY a.id")
def _(spark, d):
    return spatial.local_density(view(spark, d, "cloud"), 60.0, ["x", "y", "z"])


@query("ring_counts", f"""SELECT c.id, count(*) FILTER (WHERE d <= 10) AS n_hole, count(*) FILTER (WHERE d > 10 AND d <= 25) AS n_ring, count(*) FILTER (WHERE d > 25 AND d <= 40) AS n_shell
 FROM (SELECT a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM {POINTS} a JOIN {POINTS} b ON b.x BETWEEN a.x - 40 AND a.x + 40 WHERE a.id % 50 = 0) c GROUP BY c.id""")
def _(spark, d):
    p = points(spark, d)
    return spatial.ring_counts(p.where("id % 50 = 0"), p, 10.0, 25.0, 40.0)


@query("knn_spacing", f"""WITH n AS (SELECT a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS k
 FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id AND b.x BETWEEN a.x - 60 AND a.x + 60 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 3600) SELECT {r('quantile_cont(d, 0.5) * sqrt(pi() / 8)', 'spacing')}, count(*) AS n FROM n WHERE k = 8""")
def _(spark, d):
    near = spatial.neighbour_distance(points(spark, d), 8, 60.0)
    return near.agg((F.percentile("d", 0.5) * F.sqrt(F.pi() / 8)).alias("spacing"), F.count(F.lit(1)).alias("n"))


@query("knn_spacing_all", f"""WITH n AS (SELECT a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS k
 FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id) SELECT {r('quantile_cont(d, 0.5) * sqrt(pi() / 8)', 'spacing')}, count(*) AS n FROM n WHERE k = 8""")
def _(spark, d):
    near = spatial.kth_distance(points(spark, d), 8, 60.0)
    return near.agg((F.percentile("d", 0.5) * F.sqrt(F.pi() / 8)).alias("spacing"), F.count(F.lit(1)).alias("n"))


@query("weighted_depth", f"""WITH n AS (SELECT a.id, b.z, b.id AS o, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 800) AS w FROM {POINTS} a JOIN {POINTS} b ON b.x BETWEEN a.x - 30 AND a.x + 30 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 900),
 c AS (SELECT id, z, sum(w) OVER (PARTITION BY id ORDER BY z, o ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY id) AS tot FROM n) SELECT id, {r('min(z)', 'depth')} FROM c WHERE run >= tot / 2 - 1e-12 GROUP BY id""")
def _(spark, d):
    return spatial.weighted_depth(points(spark, d), 30.0, 20.0)


_ROIS = " UNION ALL ".join(f"SELECT {k} AS roi, {k * 400.0} AS x0, {k * 150.0} AS y0, {k * 400.0 + 300} AS x1, {k * 150.0 + 200} AS y1" for k in range(10))


@query("region_particles", f"""WITH h AS (SELECT roi, id, x - (x0 + x1) / 2 AS px, y - (y0 + y1) / 2 AS py, count(*) OVER (PARTITION BY roi) AS n FROM {POINTS} p JOIN ({_ROIS}) r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT CAST(roi AS BIGINT) AS roi, id, {r('px', 'px')}, {r('py', 'py')} FROM h WHERE n >= 5""")
def _(spark, d):
    rois = spark.createDataFrame([(k, k * 400.0, k * 150.0, k * 400.0 + 300, k * 150.0 + 200) for k in range(10)], "roi long, x0 double, y0 double, x1 double, y1 double")
    return spatial.in_regions(points(spark, d), rois).select("roi", "id", "px", "py")


_PATH = [(0.0, 0.0), (2000.0, 800.0), (4500.0, 300.0)]
_SEGS = " UNION ALL ".join(f"SELECT {k} AS k, {x} AS sx, {y} AS sy, {dx} AS dx, {dy} AS dy, {b} AS before" for k, x, y, dx, dy, b in spatial.path_segments(_PATH))


@query("line_profile", f"""WITH s AS (SELECT id, x, y, k, sx, sy, dx, dy, before, greatest(0, least(1, ((x - sx) * dx + (y - sy) * dy) / (dx * dx + dy * dy))) AS t FROM {POINTS} p, ({_SEGS}) s),
 q AS (SELECT id, k, before + t * sqrt(dx * dx + dy * dy) AS arc, sqrt(pow(x - (sx + t * dx), 2) + pow(y - (sy + t * dy), 2)) AS d FROM s),
 b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS o FROM q) SELECT CAST(floor(arc / 100) AS BIGINT) AS bin, count(*) AS n FROM b WHERE o = 1 AND d <= 120 GROUP BY 1""")
def _(spark, d):
    return spatial.line_profile(points(spark, d), _PATH, 120.0, 100.0)


_IMAGE = f"(SELECT CAST(floor(x / 250) AS BIGINT) AS ix, CAST(floor(y / 250) AS BIGINT) AS iy, avg(z) AS value FROM {POINTS} GROUP BY 1, 2)"


def _image(spark, d):
    return points(spark, d).groupBy(F.floor(F.col("x") / 250).cast("long").alias("ix"), F.floor(F.col("y") / 250).cast("long").alias("iy")).agg(F.avg("z").alias("value"))


@query("pixel_lookup", f"SELECT id, {r('value', 'signal')} FROM {POINTS} p LEFT JOIN {_IMAGE} i ON i.ix = floor((x + 40) / 250) AND i.iy = floor(y / 250)")
def _(spark, d):
    shifted = points(spark, d).withColumn("x", F.col("x") + 40)
    return spatial.sample_image(shifted, _image(spark, d), 250.0, "nearest").select("id", "signal")


@query("bilinear_lookup", f"""WITH b AS (SELECT id, floor(x / 250 - 0.5) AS bx, floor(y / 250 - 0.5) AS b_y, x / 250 - 0.5 - floor(x / 250 - 0.5) AS tx, y / 250 - 0.5 - floor(y / 250 - 0.5) AS ty FROM {POINTS}),
 t AS (SELECT id, bx + i AS ix, b_y + j AS iy, (CASE i WHEN 1 THEN tx ELSE 1 - tx END) * (CASE j WHEN 1 THEN ty ELSE 1 - ty END) AS w FROM b, (SELECT 0 AS i UNION ALL SELECT 1) a, (SELECT 0 AS j UNION ALL SELECT 1) c),
 s AS (SELECT id, sum(w * value) AS signal, count(*) AS k FROM t JOIN {_IMAGE} m USING (ix, iy) GROUP BY id) SELECT p.id, {r('CASE WHEN k = 4 THEN signal END', 'signal')} FROM {POINTS} p LEFT JOIN s ON p.id = s.id""")
def _(spark, d):
    return spatial.sample_image(points(spark, d), _image(spark, d), 250.0, "bilinear").select("id", "signal")


@query("extent", f"SELECT {', '.join(r(f'{f}({a})', f'{f}_{a}') for a in 'xyz' for f in ('min', 'max'))} FROM {CLOUD}")
def _(spark, d):
    return spatial.extent(view(spark, d, "cloud"), ["x", "y", "z"])


@query("components", f"""WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM {CLOUD} a JOIN {CLOUD} b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 900),
 c(id, root) AS (SELECT id, id FROM {CLOUD} UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id WHERE c.root < e.b)
SELECT id, min(root) AS component FROM c GROUP BY id""")
def _(spark, d):
    p = view(spark, d, "cloud")
    return graph.components(p.select("id"), spatial.band_pairs(p, 0.0, 30.0, ["x", "y", "z"]).select("a", "b"))


@query("dbscan", f"""WITH RECURSIVE n AS (SELECT a.id AS a, b.id AS b FROM {CLOUD} a JOIN {CLOUD} b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400),
 k AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4), e AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)),
 c(id, root) AS (SELECT id, id FROM k UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id WHERE c.root < e.b), m AS (SELECT id, min(root) AS cl FROM c GROUP BY id),
 g AS (SELECT n.a AS id, min(m.cl) AS cl FROM n JOIN m ON n.b = m.id GROUP BY n.a)
SELECT p.id, coalesce(m.cl, g.cl, -1) AS cluster FROM {CLOUD} p LEFT JOIN m ON p.id = m.id LEFT JOIN g ON p.id = g.id""")
def _(spark, d):
    return graph.dbscan(view(spark, d, "cloud"), 20.0, 4)


@query("repeats_in_time", f"""WITH t AS (SELECT tid, avg(x) AS x, avg(y) AS y, min(tim) AS t0, max(tim) AS t1, tid % 4 AS channel FROM {POINTS} GROUP BY tid),
 n AS (SELECT tid, lead(tid) OVER w AS next_tid, lead(t0) OVER w - t1 AS gap, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM t WINDOW w AS (PARTITION BY channel ORDER BY t0, tid))
SELECT tid, next_tid, {r('gap', 'gap')}, {r('d', 'd')} FROM n WHERE gap < 100 AND d <= 400""")
def _(spark, d):
    t = traces.centroids(points(spark, d), ["x", "y"]).withColumn("channel", F.col("tid") % 4)
    return traces.repeats_in_time(t, 100.0, 400.0)


# ---- windows ---------------------------------------------------------------------------------------------------

for _kind, _x in (("mean", "avg(eco) OVER w"), ("rms", "sqrt(avg(eco * eco) OVER w)")):

    @query(f"moving_{_kind}", f"SELECT row_id, {r(_x, 'moved')} FROM {STREAM} WINDOW w AS (PARTITION BY tid ORDER BY row_id ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)")
    def _(spark, d, kind=_kind):
        return traces.moving(stream(spark, d), "eco", 10, kind).select("row_id", "moved")


@query("trace_time_series", f"""WITH s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step, tim - lag(tim) OVER w AS dt, row_number() OVER w AS k,
  tim - min(tim) OVER p AS rel, x - avg(x) OVER p AS c_x, y - avg(y) OVER p AS c_y FROM {POINTS} WINDOW w AS (PARTITION BY tid ORDER BY id), p AS (PARTITION BY tid)),
 m AS (SELECT *, sqrt(avg(step * step) OVER (PARTITION BY tid ORDER BY id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)) AS moved FROM s)
SELECT id, {r('dt', 'dt')}, {r('rel', 'rel')}, {r('c_x', 'c_x')}, {r('c_y', 'c_y')}, {r('moved', 'moved')} FROM m WHERE k > 1""")
def _(spark, d):
    return traces.time_series(points(spark, d), ["x", "y"], 4, "id").select("id", "dt", "rel", "c_x", "c_y", "moved")


# ---- rasters ---------------------------------------------------------------------------------------------------


@query("fd_histogram", f"""WITH q AS (SELECT min(x) lo, max(x) hi, count(*) n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM {POINTS}), w AS (SELECT lo, hi, least(greatest(ceil((hi - lo) / (2 * iqr / cbrt(n))), 1), 4096) AS nb FROM q)
SELECT CAST(least(floor((x - lo) / ((hi - lo) / nb)), nb - 1) AS BIGINT) AS bin, count(*) AS n FROM {POINTS}, w GROUP BY 1""")
def _(spark, d):
    return histogram.histogram(points(spark, d), "x").select("bin", "n")


@query("stacked_histogram", f"""WITH w AS (SELECT min(eco) lo, max(eco) hi FROM {STREAM}) SELECT CAST(itr AS BIGINT) AS itr, CAST(least(floor((eco - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n FROM {STREAM}, w GROUP BY 1, 2""")
def _(spark, d):
    return histogram.histogram(stream(spark, d), "eco", 40, ["itr"]).select("itr", "bin", "n")


@query("raster2d", f"SELECT CAST(floor(x / 50) AS BIGINT) AS i_x, CAST(floor(y / 50) AS BIGINT) AS i_y, count(*) AS n, {r('avg(z)', 'mean')} FROM {POINTS} GROUP BY 1, 2")
def _(spark, d):
    return histogram.raster(points(spark, d), 50.0, value="z")


@query("raster3d", f"SELECT CAST(floor(x / 50) AS BIGINT) AS i_x, CAST(floor(y / 50) AS BIGINT) AS i_y, CAST(floor(z / 50) AS BIGINT) AS i_z, count(*) AS n FROM {CLOUD} GROUP BY 1, 2, 3")
def _(spark, d):
    return histogram.raster(view(spark, d, "cloud"), 50.0, ["x", "y", "z"])


@query("cell_density", f"SELECT id, count(*) OVER (PARTITION BY floor(x / 100), floor(y / 100)) AS den FROM {POINTS}")
def _(spark, d):
    return histogram.cell_density(points(spark, d), 100.0, ["x", "y"]).select("id", "den")


@query("pixel_mean_density", f"""WITH c AS (SELECT x, y, count(*) OVER (PARTITION BY floor(x / 100), floor(y / 100)) AS den FROM {POINTS}) SELECT CAST(floor(x / 400) AS BIGINT) AS i_x, CAST(floor(y / 400) AS BIGINT) AS i_y, count(*) AS n, {r('avg(den)', 'mean')} FROM c GROUP BY 1, 2""")
def _(spark, d):
    den = histogram.cell_density(points(spark, d), 100.0, ["x", "y"]).withColumn("den", F.col("den").cast("double"))
    return histogram.raster(den, 400.0, value="den")


@query("pyramid", f"""WITH g AS (SELECT floor(x / 25) AS a, floor(y / 25) AS b FROM {POINTS}) SELECT CAST(level AS BIGINT) AS level, CAST(floor(a / pow(2, level)) AS BIGINT) AS i_x, CAST(floor(b / pow(2, level)) AS BIGINT) AS i_y, count(*) AS n FROM g, (SELECT unnest(range(0, 5)) AS level) l GROUP BY 1, 2, 3""")
def _(spark, d):
    return histogram.pyramid(histogram.raster(points(spark, d), 25.0), 5)


@query("slab_views", f"""WITH v AS (SELECT CAST(floor(x / 40) AS BIGINT) AS i_x, CAST(floor(y / 40) AS BIGINT) AS i_y, floor(z / 40) AS i_z, count(*) AS n FROM {CLOUD} GROUP BY 1, 2, 3) SELECT i_x, i_y, max(n) AS mip, CAST(sum(n) AS BIGINT) AS total FROM v WHERE i_z BETWEEN -2 AND 2 GROUP BY 1, 2""")
def _(spark, d):
    return histogram.slab(histogram.raster(view(spark, d, "cloud"), 40.0, ["x", "y", "z"]), -2, 2)


@query("voxel_radius_count", f"""WITH g AS (SELECT CAST(floor(x / 50) AS BIGINT) AS a, CAST(floor(y / 50) AS BIGINT) AS b, count(*) AS n FROM {POINTS} GROUP BY 1, 2) SELECT p.a AS i_x, p.b AS i_y, p.n, CAST(sum(q.n) AS BIGINT) AS around FROM g p JOIN g q ON pow(p.a - q.a, 2) + pow(p.b - q.b, 2) <= 4 GROUP BY 1, 2, 3""")
def _(spark, d):
    return histogram.kernel_count(histogram.raster(points(spark, d), 50.0), 2.0)


@query("otsu", f"""WITH w AS (SELECT min(x) lo, max(x) hi FROM {POINTS}), h AS (SELECT least(floor((x - lo) / ((hi - lo) / 64)), 63) AS bin, count(*) AS n FROM {POINTS}, w GROUP BY 1),
 c AS (SELECT bin, sum(n) OVER o AS w0, sum(n * bin) OVER o AS m0, sum(n) OVER () AS tn, sum(n * bin) OVER () AS tm FROM h WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING))
SELECT CAST(bin AS BIGINT) AS bin FROM c WHERE tn > w0 ORDER BY w0 * (tn - w0) * pow(m0 / w0 - (tm - m0) / (tn - w0), 2) DESC, bin LIMIT 1""")
def _(spark, d):
    return histogram.otsu(histogram.histogram(points(spark, d), "x", 64)).select("bin")


@query("percentile_stretch", f"""WITH q AS (SELECT quantile_cont(eco, 0.01) AS a, quantile_cont(eco, 0.99) AS b FROM {STREAM}) SELECT row_id, CAST(greatest(0, least(255, round_even((eco - a) / (b - a) * 255, 0))) AS BIGINT) AS level FROM {STREAM}, q""")
def _(spark, d):
    return histogram.stretch(stream(spark, d), "eco").select("row_id", "level")


_TAPS = {
    "bilinear": [(0, "1 - {t}"), (1, "{t}")],
    "bicubic": [(-1, "(-{t} + 2 * {t} * {t} - {t} * {t} * {t}) / 2"), (0, "(2 - 5 * {t} * {t} + 3 * {t} * {t} * {t}) / 2"), (1, "({t} + 4 * {t} * {t} - 3 * {t} * {t} * {t}) / 2"), (2, "(-{t} * {t} + {t} * {t} * {t}) / 2")],
}
for _kind, _taps in _TAPS.items():
    _parts = " UNION ALL ".join(f"SELECT bx + {i} AS i_x, b_y + {j} AS i_y, ({wx.format(t='tx')}) * ({wy.format(t='ty')}) AS w FROM b" for i, wx in _taps for j, wy in _taps)

    @query(f"{_kind}_splat", f"""WITH b AS (SELECT floor(x / 100 - 0.5) AS bx, floor(y / 100 - 0.5) AS b_y, x / 100 - 0.5 - floor(x / 100 - 0.5) AS tx, y / 100 - 0.5 - floor(y / 100 - 0.5) AS ty FROM {POINTS})
SELECT CAST(i_x AS BIGINT) AS i_x, CAST(i_y AS BIGINT) AS i_y, {r('sum(w)', 'w')} FROM ({_parts}) GROUP BY 1, 2""")
    def _(spark, d, kind=_kind):
        return histogram.splat(points(spark, d), 100.0, kind)


@query("auto_levels", f"""WITH g AS (SELECT count(*) AS n FROM {POINTS} GROUP BY floor(x / 50), floor(y / 50)) SELECT {r('CASE WHEN count(*) < 4100 THEN 0 ELSE quantile_cont(n, 0.01) END', 'black')}, {r('quantile_cont(CAST(n AS double), 0.95)', 'white')} FROM g""")
def _(spark, d):
    return histogram.auto_levels(histogram.raster(points(spark, d), 50.0), 4100)


# ---- scalars ---------------------------------------------------------------------------------------------------


@query("scalar_functions", f"""SELECT row_id, {r('sqrt(2 / pi()) * eco * eco / pow(20, 3) * exp(-eco * eco / 800)', 'maxwell')}, {r('eco / (30 * 20 * sqrt(2 * pi())) * (exp(-pow(eco - 30, 2) / 800) - exp(-pow(eco + 30, 2) / 800))', 'offset_pdf')},
 CAST(row_id AS VARCHAR) || CASE WHEN row_id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN row_id % 10 = 1 THEN 'st' WHEN row_id % 10 = 2 THEN 'nd' WHEN row_id % 10 = 3 THEN 'rd' ELSE 'th' END AS ord,
 {r('eco * 0.8 - tid * 0.6 + 5', 'u')}, {r('eco * 0.6 + tid * 0.8 - 3', 'v')} FROM {STREAM}""")
def _(spark, d):
    u, v = G.homogeneous([[0.8, -0.6, 5], [0.6, 0.8, -3], [0, 0, 1]], F.col("eco"), F.col("tid").cast("double"))
    e = F.col("eco")
    return stream(spark, d).select("row_id", G.maxwell_pdf(e, 20.0).alias("maxwell"), G.offset_pdf(e, 30.0, 20.0).alias("offset_pdf"), G.ordinal(F.col("row_id")).alias("ord"), u.alias("u"), v.alias("v"))


@query("ln_positive_values", f"SELECT row_id, {r('ln(eco)', 'v')} FROM {STREAM} WHERE eco > 0 AND ln(eco) <> 0")
def _(spark, d):
    return stream(spark, d).where("eco > 0").select("row_id", F.log("eco").alias("v")).where("v <> 0")


@query("ellipse_moments", f"""WITH m AS (SELECT tid, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c, count(*) AS n FROM {POINTS} GROUP BY tid HAVING count(*) >= 5), e AS (SELECT *, (a + b) / 2 AS h, sqrt(pow((a - b) / 2, 2) + c * c) AS g FROM m)
SELECT tid, {r('4 * sqrt(h + g)', 'major')}, {r('4 * sqrt(greatest(h - g, 0))', 'minor')}, {r('degrees(atan2(2 * c, a - b)) / 2', 'angle')} FROM e""")
def _(spark, d):
    m = points(spark, d).groupBy("tid").agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    h, g = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    return m.select("tid", (4 * F.sqrt(h + g)).alias("major"), (4 * F.sqrt(F.greatest(h - g, F.lit(0.0)))).alias("minor"), (F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))) / 2).alias("angle"))


# ---- models ----------------------------------------------------------------------------------------------------


@query("equal_population", f"WITH q AS (SELECT quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM {POINTS}) SELECT CAST(unnest(range(0, 6)) AS BIGINT) AS part, round(CAST(unnest(q) AS double) + {SHIFT:.9f}, 4) + 0.0 AS cut FROM q")
def _(spark, d):
    return models.equal_population(points(spark, d), "x", 5)


_PROFILE = f"(SELECT CAST(floor(x / 20) AS BIGINT) AS bin, count(*) AS n FROM {POINTS} GROUP BY 1)"


def _profile(spark, d):
    return points(spark, d).groupBy(F.floor(F.col("x") / 20).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("period_spectrum", f"""WITH p AS {_PROFILE}, s AS (SELECT min(bin) AS b0, max(bin) AS b1, sum(n) AS t FROM p), f AS (SELECT unnest(range(b0, b1 + 1)) AS bin, b0, b1 - b0 + 1 AS k, t / (b1 - b0 + 1) AS m FROM s),
 r AS (SELECT (f.bin - b0) * 20.0 AS pos, (coalesce(n, 0) - m) * (0.5 - 0.5 * cos(2 * pi() * (f.bin - b0) / (k - 1))) AS v FROM f LEFT JOIN p ON f.bin = p.bin)
SELECT CAST(period AS double) + 0.0 AS period, round(pow(sum(v * cos(2 * pi() * pos / period)), 2) + pow(sum(v * sin(2 * pi() * pos / period)), 2) + {SHIFT:.9f}, 4) + 0.0 AS power FROM r, (SELECT unnest([100, 150, 250, 400, 800]) AS period) GROUP BY period""")
def _(spark, d):
    return models.period_spectrum(_profile(spark, d), 20.0, [100, 150, 250, 400, 800])


@query("autocorrelation", f"""WITH p AS {_PROFILE}, c AS (SELECT bin, n - avg(n) OVER () AS v FROM p), r AS (SELECT l AS lag, avg(a.v * b.v) AS r FROM c a, c b, (SELECT unnest(range(0, 11)) AS l) WHERE b.bin = a.bin + l GROUP BY l)
SELECT lag, {r('r / (SELECT r FROM r WHERE lag = 0)', 'r')} FROM r""")
def _(spark, d):
    return models.autocorrelation(_profile(spark, d), 10)


@query("symmetry", f"""WITH p AS (SELECT x - avg(x) OVER () AS dx, y - avg(y) OVER () AS dy FROM {CLOUD}), q AS (SELECT *, sqrt(dx * dx + dy * dy) AS rad FROM p), h AS (SELECT floor((atan2(dy, dx) / (2 * pi()) + 0.5) * 72) AS b, count(*) AS n FROM q WHERE rad >= 0.3 * (SELECT quantile_cont(rad, 0.5) FROM q) GROUP BY 1)
SELECT fold, {r('sqrt(pow(sum(n * cos(2 * pi() * (b + 0.5) / 72 * fold)), 2) + pow(sum(n * sin(2 * pi() * (b + 0.5) / 72 * fold)), 2)) / sum(n)', 'power')} FROM h, (SELECT unnest(range(2, 13)) AS fold) GROUP BY fold""")
def _(spark, d):
    return models.symmetry(view(spark, d, "cloud"))


@query("two_gaussian_mixture")
def _(spark, d):
    x, n = models.binned(stream(spark, d), "eco")
    fit = models.fit_mixture(x, n, 2)
    rows = [(k, w, *p) for k, (w, p) in enumerate(zip(fit["weights"], fit["params"], strict=True))]
    return spark.createDataFrame([tuple(map(float, row)) for row in rows], "component double, weight double, mean double, sigma double")


@query("mixture_search")
def _(spark, d):
    fit = models.search_mixture(*models.binned(stream(spark, d), "eco", 512))
    return spark.createDataFrame([(fit["kind"], len(fit["weights"]), float(fit["bic"]))], "kind string, k long, bic double")


@query("ring_correlation")
def _(spark, d):
    return models.ring_correlation(points(spark, d), 20.0, 2)


@query("time_window_drift")
def _(spark, d):
    p = points(spark, d)
    e = p.agg(F.min("tim").alias("a"), F.max("tim").alias("b")).first()
    return models.drift(p, (e["b"] - e["a"]) / 8.01, 50.0)


@query("template_detections")
def _(spark, d):
    return segmentation.detections(view(spark, d, "cloud"), 10.0, "gaussian", 40.0, 10.0, 0.5).select("x", "y", "score")


@query("ridge_skeleton")
def _(spark, d):
    return segmentation.skeleton(points(spark, d), 20.0)


# ---- particles -------------------------------------------------------------------------------------------------


def _particles(spark, d):
    return view(spark, d, "cloud").withColumn("particle", F.col("tid"))


@query("centred_particles", f"SELECT id, {r('x - avg(x) OVER (PARTITION BY tid)', 'x')}, {r('y - avg(y) OVER (PARTITION BY tid)', 'y')}, {r('z - avg(z) OVER (PARTITION BY tid)', 'z')} FROM {CLOUD}")
def _(spark, d):
    return particles.centred(_particles(spark, d)).select("id", "x", "y", "z")


@query("pooled_transforms", f"SELECT tid AS particle, {r('x * 0.6 - y * 0.8 + tid', 'x')}, {r('x * 0.8 + y * 0.6', 'y')}, {r('z - 2 * tid', 'z')} FROM {CLOUD}")
def _(spark, d):
    m = _particles(spark, d).select("particle").distinct().select("particle", F.array(*(F.lit(v).cast("double") if not isinstance(v, str) else F.expr(v).cast("double") for v in [0.6, -0.8, 0, "particle", 0.8, 0.6, 0, 0, 0, 0, 1, "-2 * particle", 0, 0, 0, 1])).alias("m"))
    return particles.pooled(_particles(spark, d), m)


@query("symmetrized", f"""SELECT id, {r('x * cos(pi() / 2 * k) - y * sin(pi() / 2 * k)', 'x')}, {r('x * sin(pi() / 2 * k) + y * cos(pi() / 2 * k)', 'y')} FROM {CLOUD}, (SELECT unnest(range(0, 4)) AS k)""")
def _(spark, d):
    return particles.symmetrized(_particles(spark, d), 4).select("id", "x", "y")


@query("cloud_overlap", f"SELECT {r('sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 14400))', 'overlap')} FROM {CLOUD} a, {CLOUD} b WHERE a.tid = 1 AND b.tid = 2 AND abs(a.x - b.x) <= 480 AND abs(a.y - b.y) <= 480")
def _(spark, d):
    return particles.overlap(_particles(spark, d), 1, 2, 60.0)


@query("hull_shapes")
def _(spark, d):
    return particles.hull_shapes(particles.hull(_particles(spark, d)))


@query("particle_average")
def _(spark, d):
    return particles.averaged(_particles(spark, d), 20.0, 32, rounds=2).select("particle", "x", "y", "score")


@query("separated_peaks")
def _(spark, d):
    p = points(spark, d).select("id", "x", "y", F.col("z").alias("score"))
    return spatial.apart(p, 30.0)


@query("frames_by_time", f"SELECT id, CAST(dense_rank() OVER (ORDER BY tim) - 1 AS BIGINT) AS frame, {r('(x - min(x) OVER ()) / 160', 'x')}, {r('(y - min(y) OVER ()) / 160', 'y')} FROM {POINTS}")
def _(spark, d):
    return sinks.frames_by_time(points(spark, d), 160.0).select("id", "frame", "x", "y")


# ---- streams ---------------------------------------------------------------------------------------------------


def _drained(result: DataFrame, mode: str, name: str) -> DataFrame:
    """A bounded stream run to its end into a table in the shared folder."""
    import uuid

    from tracelake.storage import shared_dir

    spark = result.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = result.schema

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def _stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parque[t]")
    return events.select(F.col("user_id").alias("tid"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("eco"))


@query("stream_windows", f"SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, count(*) AS n, {r('avg(value)', 'mean')} FROM events GROUP BY 1")
def _(spark, d):
    out = streams.windowed(_stream_of(spark, d), "ts", "eco", "1 hour")
    return _drained(out, "complete", "stream-windows").select(F.unix_micros("start").alias("start_us"), "n", "mean")


@query("stream_photon_bins", f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY row_id) AS k FROM {STREAM}),
f AS (SELECT tid, k, eco AS acc, CAST(0 AS BIGINT) AS chunk FROM o WHERE k = 1
 UNION ALL SELECT o.tid, o.k, CASE WHEN f.acc >= 500 THEN 0 ELSE f.acc END + o.eco, f.chunk + CASE WHEN f.acc >= 500 THEN 1 ELSE 0 END FROM f JOIN o ON o.tid = f.tid AND o.k = f.k + 1)
SELECT tid, chunk, count(*) AS n, {r('arg_max(acc, k)', 'photons')} FROM f GROUP BY 1, 2 HAVING arg_max(acc, k) >= 500""")
def _(spark, d):
    return _drained(streams.photon_bins(_stream_of(spark, d), 500.0), "append", "stream-bins")


# ---- overlays, paths and resampling ----------------------------------------------------------------------------


@query("overlay_shift", f"""WITH p AS (SELECT *, tid % 3 AS channel FROM {POINTS}), c AS (SELECT channel, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy FROM p GROUP BY channel)
SELECT id, {r('x + (SELECT cx FROM c WHERE channel = 0) - cx', 'x')}, {r('y + (SELECT cy FROM c WHERE channel = 0) - cy', 'y')} FROM p JOIN c USING (channel)""")
def _(spark, d):
    return overlay.shifted_to_first(points(spark, d).withColumn("channel", F.col("tid") % 3)).select("id", "x", "y")


_IMAGES = " UNION ALL ".join(f"SELECT {k} AS image, {k * 37.0} AS x0, {k * 11.0} AS y0, {k * 37.0 + 100} AS x1, {k * 11.0 + 80} AS y1" for k in range(40))


@query("geometry_matches", f"""WITH i AS ({_IMAGES}), b AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS roi, min(o_orderkey % 1500) AS x0, min(o_orderkey % 440) AS y0 FROM orders GROUP BY 1), q AS (SELECT roi, x0 + 0.0 AS x0, y0 + 0.0 AS y0, x0 + 100.0 AS x1, y0 + 80.0 AS y1 FROM b),
 e AS (SELECT CAST(image AS BIGINT) AS image, roi, greatest(abs(i.x0 - q.x0), abs(i.y0 - q.y0), abs(i.x1 - q.x1), abs(i.y1 - q.y1)) / 100.0 AS error FROM i, q) SELECT image, roi, {r('error', 'error')} FROM e WHERE error <= 0.4""")
def _(spark, d):
    images = spark.createDataFrame([(k, k * 37.0, k * 11.0, k * 37.0 + 100, k * 11.0 + 80) for k in range(40)], "image long, x0 double, y0 double, x1 double, y1 double")
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % 50).cast("long").alias("roi")).agg(F.min(F.col("o_orderkey") % 1500).cast("double").alias("x0"), F.min(F.col("o_orderkey") % 440).cast("double").alias("y0"))
    return overlay.geometry_matches(images, o.withColumn("x1", F.col("x0") + 100).withColumn("y1", F.col("y0") + 80), 0.4)


@query("box_query", f"SELECT id FROM {POINTS} WHERE x BETWEEN 950 AND 1810 AND y BETWEEN 210 AND 777")
def _(spark, d):
    return overlay.box_query(histogram.cells(points(spark, d), 50.0, ["x", "y"]), 950.0, 210.0, 1810.0, 777.0, 50.0).select("id")


@query("two_channel_ratio", f"SELECT coalesce(max(abs(eco / 100 + (1 - eco / 100) - 1)) < 0.001, false) AS two_channels FROM (SELECT * FROM {STREAM} ORDER BY row_id LIMIT 500)")
def _(spark, d):
    s = stream(spark, d).withColumn("a", F.col("eco") / 100).withColumn("b", 1 - F.col("a"))
    return overlay.two_channel_ratio(s, "a", "b")


@query("smoothed_density", f"""WITH g AS (SELECT CAST(floor(x / 50) AS BIGINT) AS a, CAST(floor(y / 50) AS BIGINT) AS b, count(*) AS n FROM {POINTS} GROUP BY 1, 2) SELECT p.a AS i_x, p.b AS i_y, p.n, {r('sum(q.n * exp(-(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) / 4.5))', 'density')}
 FROM g p JOIN g q ON abs(p.a - q.a) <= 4 AND abs(p.b - q.b) <= 4 GROUP BY 1, 2, 3""")
def _(spark, d):
    return overlay.smoothed_density(points(spark, d), 50.0, 1.5)


@query("pooled_ratio", f"WITH {ISLANDS} SELECT tid, CAST(isl AS BIGINT) AS isl, {r('sum(itr * eco) / sum(eco)', 'ratio')} FROM isl WHERE itr IN (1, 2, 4) AND eco > 0 GROUP BY tid, isl")
def _(spark, d):
    s = selection.with_islands(stream(spark, d)).where(F.col("itr").isin(1, 2, 4) & (F.col("eco") > 0)).withColumn("ratio", F.col("itr").cast("double"))
    return channels.group_weighted_mean(s, "ratio", "eco", ["tid", "isl"]).withColumnRenamed("wmean", "ratio")


_WALK = f"""(SELECT tid AS path, id AS k, x, y FROM {POINTS})"""


@query("path_lengths", f"""WITH s AS (SELECT path, k, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS s FROM {_WALK} WINDOW w AS (PARTITION BY path ORDER BY k)) SELECT path, k, {r('sum(s) OVER (PARTITION BY path ORDER BY k ROWS UNBOUNDED PRECEDING)', 'arc')} FROM s""")
def _(spark, d):
    return paths.arc_lengths(points(spark, d).select(F.col("tid").alias("path"), F.col("id").alias("k"), "x", "y")).select("path", "k", "arc")


@query("resampled_paths", f"""WITH s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS s FROM {_WALK} WINDOW w AS (PARTITION BY path ORDER BY k)), a AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY k ROWS UNBOUNDED PRECEDING) AS arc FROM s),
 n AS (SELECT *, lead(arc) OVER w AS na, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM a WINDOW w AS (PARTITION BY path ORDER BY k)), f AS (SELECT *, ceil(arc / 500 - 1e-12) AS j0, ceil(na / 500 - 1e-12) - 1 AS j1 FROM n WHERE na > arc),
 e AS (SELECT *, unnest(range(CAST(j0 AS BIGINT), CAST(j1 AS BIGINT) + 1)) AS j FROM f WHERE j1 >= j0) SELECT path, {r('j * 500', 'arc')}, {r('x + (j * 500 - arc) / (na - arc) * (nx - x)', 'x')}, {r('y + (j * 500 - arc) / (na - arc) * (ny - y)', 'y')} FROM e""")
def _(spark, d):
    out = paths.resampled(points(spark, d).select(F.col("tid").alias("path"), F.col("id").alias("k"), "x", "y"), 500.0)
    return out.withColumn("arc", F.col("arc").cast("double"))


@query("straightened_volume")
def _(spark, d):
    t = np.linspace(0, 1, 60)
    line = np.stack([-200 + 400 * t, 60 * np.sin(3 * t), 40 * t], axis=1)
    return paths.straightened(view(spark, d, "cloud"), line, 80.0, 20.0)


@query("envelope_null")
def _(spark, d):
    return resampling.envelope(points(spark, d), 200.0, 20.0, 4.0, 5)


@query("profile_excess")
def _(spark, d):
    p = points(spark, d)
    return resampling.excess(spatial.pair_profile(p, 20.0, 4.0), resampling.envelope(p, 200.0, 20.0, 4.0, 5), 0, 2)


@query("bootstrap_interval")
def _(spark, d):
    return resampling.bootstrap_mean(points(spark, d), "tid", "x", 100)


@query("strata", f"SELECT id, CAST(floor((row_number() OVER (PARTITION BY tid % 5 ORDER BY x, id) - 1) / 64) AS BIGINT) AS stratum FROM {POINTS}")
def _(spark, d):
    return resampling.strata(points(spark, d).withColumn("g", F.col("tid") % 5), "x", 64, "g").select("id", "stratum")


@query("within_group_pairs", f"""WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM {CLOUD} a JOIN {CLOUD} b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 625),
 c(id, root) AS (SELECT id, id FROM {CLOUD} UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id WHERE c.root < e.b), m AS (SELECT id, min(root) AS g FROM c GROUP BY id)
SELECT ma.g AS "group", a.id AS a, b.id AS b, {r('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))', 'd')} FROM {CLOUD} a JOIN {CLOUD} b ON a.id < b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 3600 JOIN m ma ON ma.id = a.id JOIN m mb ON mb.id = b.id WHERE ma.g = mb.g""")
def _(spark, d):
    return resampling.within_groups(view(spark, d, "cloud"), 25.0, 60.0)


@query("merged_sites")
def _(spark, d):
    return resampling.merged_sites(points(spark, d), 3.0, 6.0)


@query("approach_removed")
def _(spark, d):
    return traces.without_approach(points(spark, d).withColumnRenamed("id", "row_id"), ["x", "y"], 4, 900.0).select("row_id", "tid")


@query("anisotropy", f"""WITH c AS (SELECT tid, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy, quantile_cont(z, 0.5) AS cz FROM {CLOUD} GROUP BY tid), q AS (SELECT abs(x - cx) AS x, abs(y - cy) AS y, abs(z - cz) AS z FROM {CLOUD} JOIN c USING (tid)),
 s AS (SELECT exp(avg(CASE WHEN x > 0 THEN ln(x) END)) AS sx, exp(avg(CASE WHEN y > 0 THEN ln(y) END)) AS sy, exp(avg(CASE WHEN z > 0 THEN ln(z) END)) AS sz FROM q) SELECT {r('sx', 'sx')}, {r('sy', 'sy')}, {r('sz', 'sz')}, {r('sqrt(sx * sy) / sz', 'z_scale')} FROM s""")
def _(spark, d):
    return traces.anisotropy(view(spark, d, "cloud"))


@query("profile_half_width")
def _(spark, d):
    image = _image(spark, d)
    across = segmentation.profile_across(image, [(1000.0, 600.0), (2000.0, 900.0), (3000.0, 1000.0)], 250.0, 2)
    return models.half_width(across.select(F.col("offset").alias("x"), "v"))


@query("merged_channel_windows", f"""WITH w AS (SELECT min(eco) AS lo, max(eco) AS hi FROM {STREAM}) SELECT CAST(least(floor((eco - lo) / ((hi - lo) / 6)), 5) AS BIGINT) AS part, count(*) AS n, {r('avg(eco)', 'mean')} FROM {STREAM}, w GROUP BY 1""")
def _(spark, d):
    s = stream(spark, d)
    e = s.agg(F.min("eco").alias("lo"), F.max("eco").alias("hi")).first()
    bins = histogram.bin_of(F.col("eco"), F.lit(e["lo"]), F.lit((e["hi"] - e["lo"]) / 6), F.lit(6))
    return s.groupBy(bins.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg("eco").alias("mean"))


@query("session_runs", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nw FROM events),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT CAST(user_id AS BIGINT) AS tid, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("tid"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.sessions(e, "ts", "tid", "12 hours").select("tid", F.unix_micros("start").alias("start_us"), "n")


@query("traces_of_interest", f"SELECT DISTINCT tid FROM {POINTS} WHERE tid <> 0")
def _(spark, d):
    return points(spark, d).where("tid <> 0").select("tid").distinct()


@query("principal_axis", f"""WITH m AS (SELECT tid, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM {CLOUD} GROUP BY tid) SELECT tid, {r('degrees(atan2(2 * c, a - b)) / 2', 'angle')}, {r('sqrt((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c))', 'spread')} FROM m""")
def _(spark, d):
    m = view(spark, d, "cloud").groupBy("tid").agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    a, b, c = map(F.col, "abc")
    return m.select("tid", (F.degrees(F.atan2(2 * c, a - b)) / 2).alias("angle"), F.sqrt((a + b) / 2 + F.sqrt(F.pow((a - b) / 2, 2) + c * c)).alias("spread"))


@query("nested_iterations", f"""SELECT tid AS conv, CAST(row_number() OVER (PARTITION BY tid ORDER BY row_id) - 1 AS BIGINT) AS itr, {r('eco', 'eco')} FROM {LADDER}""")
def _(spark, d):
    rows = view(spark, d, "ladder").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("row_id", "eco"))).alias("s"))
    nested = rows.select(F.col("tid").alias("row_id"), F.transform("s", lambda e: e.eco).alias("eco"))
    return tables.unnested(nested).select(F.col("loc_row").alias("conv"), "itr", "eco")


@query("canonical_positions", f"SELECT id AS row_id, tid, {r('x * 1000', 'x')}, {r('y * 1000', 'y')}, {r('z * 700', 'z')} FROM {POINTS}")
def _(spark, d):
    raw = points(spark, d).select(F.col("id").alias("row_id"), F.col("tid").alias("track"), F.col("x").alias("x_um"), F.col("y").alias("y_um"), F.col("z").alias("z_um"))
    return tables.canonical(raw, {"x": "x_um", "y": "y_um", "z": "z_um", "tid": "track"}, unit="um", z_scale=0.7).select("row_id", "tid", "x", "y", "z")


@query("column_profile", f"""WITH s AS (SELECT eco, eco - lag(eco) OVER (PARTITION BY row_id // 65536 ORDER BY row_id) AS d FROM {STREAM}) SELECT count(eco) AS n, count(DISTINCT eco) AS "distinct", {r('min(eco)', 'low')}, {r('max(eco)', 'high')}, bool_and(eco = floor(eco)) AS whole, {r('quantile_cont(abs(d), 0.5)', 'step')}, {r('avg(CASE WHEN d > 0 THEN 1.0 WHEN d <= 0 THEN 0.0 END)', 'rising')} FROM s""")
def _(spark, d):
    return tables.column_profile(stream(spark, d), "eco", "row_id")


@query("filtered_snapshot", f"SELECT row_id, {r('eco', 'eco')}, {on_bounds('avg(eco) OVER (PARTITION BY tid)', 30, 50)} AND eco >= 5 AS ftr FROM {STREAM}")
def _(spark, d):
    return sinks.snapshot(stream(spark, d), [Spec("eco", "mean", 30, 50), Spec("eco", "loc", 5)], flag=True).select("row_id", "eco", "ftr")
