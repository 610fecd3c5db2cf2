"""Per-trace statistics: precision, sizes, tables and time series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number


def precision(df: DataFrame, axes: Sequence[str] = ("x", "y", "z"), min_rows: int = 5, scale: float = 1.0) -> DataFrame:
    """``(tid, n, sd_<axis>.., sigma_r)``: sample deviations of traces with enough rows."""
    sds = [F.stddev_samp(F.col(a) * scale).alias(f"sd_{a}") for a in axes]
    out = df.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), *sds).where(F.col("n") >= min_rows)
    return out.withColumn("sigma_r", F.sqrt((F.pow(f"sd_{axes[0]}", 2) + F.pow(f"sd_{axes[1]}", 2)) / 2))


def precision_summary(per_trace: DataFrame) -> DataFrame:
    """One row: traces, median and mean radial deviation, and the mean weighted by 2 (n - 1)."""
    w = 2 * (F.col("n") - 1)
    return per_trace.agg(
        F.count(F.lit(1)).alias("traces"), F.percentile("sigma_r", 0.5).alias("median"), F.avg("sigma_r").alias("mean"), (F.sum(F.col("sigma_r") * w) / F.sum(w)).alias("weighted")
    )


def crlb(df: DataFrame, photons: str, background: str, pattern: float) -> DataFrame:
    """``crb``: lower bound of the deviation for a donut pattern of diameter ``pattern``, from photons and background share."""
    sbr = F.when(F.col(background) > 0, F.col(photons) / F.col(background)).otherwise(1e9)
    bound = pattern / (4 * F.sqrt(F.col(photons))) * F.sqrt((1 + 1 / sbr) * (1 + 3 / (4 * sbr)))
    return df.withColumn("crb", F.when(F.col(photons) > 0, bound))


def excess(df: DataFrame, measured: str, bound: str) -> DataFrame:
    """``excess``: what the measured deviation has beyond the bound."""
    return df.withColumn("excess", F.sqrt(F.greatest(F.pow(measured, 2) - F.pow(bound, 2), F.lit(0.0))))


def centroids(df: DataFrame, axes: Sequence[str] = ("x", "y", "z"), min_rows: int = 1) -> DataFrame:
    """``(tid, n, <axis>.., sem_<axis>.., t0, t1)``."""
    means = [F.avg(a).alias(a) for a in axes] + [(F.stddev_samp(a) / F.sqrt(F.count(F.lit(1)))).alias(f"sem_{a}") for a in axes]
    return df.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), *means, F.min("tim").alias("t0"), F.max("tim").alias("t1")).where(F.col("n") >= min_rows)


def log_sizes(df: DataFrame, axes: Sequence[str], step: float = 0.25) -> DataFrame:
    """One row of sizes from the distances to each trace's median centre: ``geometric``, ``median``, ``modal`` (of log bins)."""
    centre = df.groupBy("tid").agg(*(F.percentile(a, 0.5).alias(f"__{a}") for a in axes))
    d2 = sum((F.pow(F.col(a) - F.col(f"__{a}"), 2) for a in axes[1:]), F.pow(F.col(axes[0]) - F.col(f"__{axes[0]}"), 2))
    logs = df.join(centre, "tid").select((F.log(d2) / 2).alias("g")).where("g IS NOT NULL AND NOT isnan(g) AND g > -700")
    bins = logs.groupBy(F.floor(F.col("g") / step).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("s"))
    modal = bins.agg(F.max_by(F.col("bin"), F.struct(F.col("n"), -F.col("bin"))).alias("bin"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    half = logs.agg(F.percentile("g", 0.5).alias("m"))
    return modal.crossJoin(half).select(F.exp(F.col("s") / F.col("n")).alias("geometric"), F.exp("m").alias("median"), F.exp((F.col("bin") + 0.5) * step).alias("modal"), "n")


def anisotropy(df: DataFrame, step: float = 0.25) -> DataFrame:
    """One row: geometric sizes by axis, and the z scale sqrt(sx sy) / sz."""
    parts = [log_sizes(df, [a], step).select(F.col("geometric").alias(f"s{a}")) for a in "xyz"]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).withColumn("z_scale", F.sqrt(F.col("sx") * F.col("sy")) / F.col("sz"))


def trace_table(df: DataFrame, axes: Sequence[str] = ("x", "y", "z"), order: str = "row_id") -> DataFrame:
    """Per trace but trace 0: rows, means, mean time step and speed, diagonal of the bounding box."""
    w = Window.partitionBy("tid").orderBy(order)
    dt = F.col("tim") - F.lag("tim").over(w)
    d2 = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes[1:]), F.pow(F.col(axes[0]) - F.lag(axes[0]).over(w), 2))
    steps = df.where("tid <> 0").withColumn("__dt", dt).withColumn("__v", F.when(dt > 0, F.sqrt(d2) / dt))
    box = sum((F.pow(F.max(a) - F.min(a), 2) for a in axes[1:]), F.pow(F.max(axes[0]) - F.min(axes[0]), 2))
    return steps.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"mean_{a}") for a in axes), F.avg("__dt").alias("mean_dt"), F.avg("__v").alias("mean_speed"), F.sqrt(box).alias("diagonal"))


def moving(df: DataFrame, value: str, width: int, kind: str = "mean", order: str = "row_id") -> DataFrame:
    """``moved``: centred moving mean, or rms, with frames that shrink at the ends; an even frame takes one more row after."""
    w = Window.partitionBy("tid").orderBy(order).rowsBetween(-((width - 1) // 2), width // 2)
    v = F.col(value)
    return df.withColumn("moved", F.sqrt(F.avg(v * v).over(w)) if kind == "rms" else F.avg(v).over(w))


def time_series(df: DataFrame, axes: Sequence[str], width: int, order: str = "row_id") -> DataFrame:
    """Per row but a trace's first: centred coordinates, relative time, time step and moving rms of the step length."""
    whole, w = Window.partitionBy("tid"), Window.partitionBy("tid").orderBy(order)
    d2 = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes[1:]), F.pow(F.col(axes[0]) - F.lag(axes[0]).over(w), 2))
    out = df.withColumn("step", F.coalesce(F.sqrt(d2), F.lit(0.0))).withColumn("dt", F.col("tim") - F.lag("tim").over(w)).withColumn("rel", F.col("tim") - F.min("tim").over(whole))
    for a in axes:
        out = out.withColumn(f"c_{a}", F.col(a) - F.avg(a).over(whole))
    out = out.withColumn("__k", F.row_number().over(w))
    return moving(out, "step", width, "rms", order).where("__k > 1").drop("__k")


def without_approach(df: DataFrame, axes: Sequence[str], width: int, near: float, order: str = "row_id") -> DataFrame:
    """``tid`` set to 0 on a trace's leading rows: those before the first row, at or after the first rise of its
    moving rms step, that lies within ``near`` of the trace's centre. A trace without such a row stays."""
    whole, w = Window.partitionBy("tid"), Window.partitionBy("tid").orderBy(order)
    s = time_series(df.withColumn("__tid", F.col("tid")), axes, width, order)
    s = s.withColumn("__rise", F.col("moved") > F.lag("moved").over(w))
    s = s.withColumn("__first", F.min(F.when(F.col("__rise"), F.col(order))).over(whole))
    d2 = sum((F.pow(F.col(f"c_{a}"), 2) for a in axes[1:]), F.pow(f"c_{axes[0]}", 2))
    start = s.where((F.col(order) >= F.col("__first")) & (F.sqrt(d2) <= near)).groupBy("tid").agg(F.min(order).alias("__start"))
    return df.join(start, "tid", "left").withColumn("tid", F.when(F.col(order) < F.col("__start"), 0).otherwise(F.col("tid")).cast("long")).drop("__start")


def repeats_in_time(traces: DataFrame, gap: float, reach: float, part: str = "channel", axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Consecutive traces of a part by start time, whose gap is below ``gap`` and whose distance is at most ``reach``."""
    w = Window.partitionBy(part).orderBy("t0", "tid")
    nxt = {c: F.lead(c).over(w) for c in ("tid", "t0", *axes)}
    d2 = sum((F.pow(nxt[a] - F.col(a), 2) for a in axes[1:]), F.pow(nxt[axes[0]] - F.col(axes[0]), 2))
    out = traces.select("tid", nxt["tid"].alias("next_tid"), (nxt["t0"] - F.col("t1")).alias("gap"), F.sqrt(d2).alias("d"))
    return out.where((F.col("gap") < gap) & (F.col("d") <= reach))


def resolution_bins(n: int) -> int:
    """Bins of a histogram of n values by the rule of Sturges, at least 1."""
    return max(1, math.ceil(math.log2(max(n, 1))) + 1)


def finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(number(c).isNotNull())
    return df
