"""Channels: labels for traces, unions of channels, and their alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number, weighted_mean
from tracelake.operators.filters import value_window
from tracelake.operators.selection import dense_tids


def vote(df: DataFrame, label: Column, min_share: float = 0.0) -> DataFrame:
    """``(tid, channel)``: a trace's most frequent label of 0 or more; ties, low agreement and no votes give -1."""
    counts = df.select("tid", label.alias("label")).where("label >= 0").groupBy("tid", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tid")
    top = counts.withColumn("best", F.max("n").over(w)).withColumn("total", F.sum("n").over(w)).where("n = best")
    won = top.groupBy("tid").agg(F.count(F.lit(1)).alias("ties"), F.min("label").alias("label"), F.max("best").alias("best"), F.max("total").alias("total"))
    ok = (F.col("ties") == 1) & (F.col("best") / F.col("total") >= min_share)
    return df.select("tid").distinct().join(won.select("tid", F.when(ok, F.col("label")).otherwise(-1).alias("channel")), "tid", "left").fillna(-1, ["channel"])


def assign_traces(df: DataFrame, value: str, windows: Sequence[tuple[float, float]], how: str, min_share: float = 0.0) -> DataFrame:
    """``(tid, channel)`` by the window of a trace's ``mean`` or ``median``, or by ``majority``."""
    if how == "majority":
        return vote(df, value_window(F.col(value), windows), min_share)
    agg = {"mean": F.avg(number(value)), "median": F.percentile(number(value), 0.5)}[how]
    return df.groupBy("tid").agg(agg.alias("__v")).select("tid", value_window(F.col("__v"), windows).alias("channel"))


def group_weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(weighted_mean(F.col(value), F.col(weight)).alias("wmean"))


def flatten(channels: Mapping[int, DataFrame]) -> DataFrame:
    """All channels as one table on the columns they share, with dense trace numbers."""
    shared = [c for c in next(iter(channels.values())).columns if all(c in d.columns for d in channels.values())]
    union = None
    for k in sorted(channels):
        one = channels[k].select(*shared, F.lit(k).alias("channel"))
        union = one if union is None else union.unionByName(one)
    return union.join(dense_tids(union), ["channel", "tid"]).drop("tid").withColumnRenamed("new_tid", "tid")


def reconstruct(parts: Sequence[DataFrame]) -> DataFrame:
    """Channels back into one table, on the columns that all have, with the original traces."""
    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    out = parts[0].select(*shared)
    for p in parts[1:]:
        out = out.unionByName(p.select(*shared))
    return out


def bead_medians(beads: DataFrame, first: int, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(gri, *axes)``: medians of each bead's first samples in time."""
    w = Window.partitionBy("gri").orderBy("tim", "row_id")
    head = beads.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first)
    return head.groupBy("gri").agg(*(F.percentile(a, 0.5).alias(a) for a in axes))


def rigid_plane(left: DataFrame, right: DataFrame) -> tuple[float, float, float]:
    """(angle, shift x, shift y) that move ``left`` onto ``right``; both (gri, x, y). From sums, one row."""
    j = left.alias("a").join(right.alias("b"), "gri")
    m = j.agg(*(F.avg(f"{t}.{c}").alias(f"{t}{c}") for t in "ab" for c in "xy"), F.count(F.lit(1)).alias("n")).first()
    if not m["n"]:
        raise ValueError("no common beads")
    ax, ay, bx, by = F.col("a.x") - m["ax"], F.col("a.y") - m["ay"], F.col("b.x") - m["bx"], F.col("b.y") - m["by"]
    s = j.agg(F.sum(ax * bx + ay * by).alias("c"), F.sum(ax * by - ay * bx).alias("s")).first()
    angle = float(np.arctan2(s["s"], s["c"])) if m["n"] > 1 else 0.0
    c, sn = np.cos(angle), np.sin(angle)
    return angle, float(m["bx"] - (c * m["ax"] - sn * m["ay"])), float(m["by"] - (sn * m["ax"] + c * m["ay"]))


def effective_transform(requested: str, beads: int) -> str:
    """What so many common beads allow: fewer than 3 a translation, 3 a rigid plane, 4 or more what was asked for."""
    if beads < 3:
        return "translation"
    return "rigid_xy_z" if beads == 3 and requested == "rigid_xyz" else requested


def rigid_space(points: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """4x4 least-squares rotation and shift between a few matched points."""
    a, b = points.mean(0), onto.mean(0)
    u, _, vt = np.linalg.svd((points - a).T @ (onto - b))
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ d @ u.T
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, b - r @ a
    return out


def bead_drift(beads: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Each bead's positions minus its median, times from its first sample."""
    base = beads.groupBy("gri").agg(*(F.percentile(a, 0.5).alias(f"__{a}") for a in axes), F.min("tim").alias("__t"))
    out = beads.join(base, "gri")
    for a in axes:
        out = out.withColumn(a, F.col(a) - F.col(f"__{a}"))
    return out.withColumn("tim", F.col("tim") - F.col("__t")).drop("__t", *(f"__{a}" for a in axes))
