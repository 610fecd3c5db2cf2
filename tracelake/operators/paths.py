"""Paths: arc length, resampling, and volumes along a centre line."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arc_lengths(vertices: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``arc``: length of the path up to each vertex. vertices: (path, k, x, y)."""
    w = Window.partitionBy("path").orderBy("k")
    d2 = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes[1:]), F.pow(F.col(axes[0]) - F.lag(axes[0]).over(w), 2))
    run = vertices.withColumn("__s", F.coalesce(F.sqrt(d2), F.lit(0.0)))
    return run.withColumn("arc", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def resampled(vertices: DataFrame, step: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``(path, arc, x, y)`` at multiples of a step along each path: every segment gives the multiples it holds."""
    w = Window.partitionBy("path").orderBy("k")
    s = arc_lengths(vertices, axes)
    for a in ("arc", *axes):
        s = s.withColumn(f"n_{a}", F.lead(a).over(w))
    s = s.where(F.col("n_arc") > F.col("arc"))
    first, last = F.ceil(F.col("arc") / step - 1e-12), F.ceil(F.col("n_arc") / step - 1e-12) - 1
    each = s.where(last >= first).withColumn("j", F.explode(F.sequence(first, last)))
    t = (F.col("j") * step - F.col("arc")) / (F.col("n_arc") - F.col("arc"))
    return each.select("path", (F.col("j") * step).alias("arc"), *((F.col(a) + t * (F.col(f"n_{a}") - F.col(a))).alias(a) for a in axes))


def frames(vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tangent, normal and binormal at each vertex of a centre line, turned as little as possible from one to the next."""
    t = np.gradient(vertices, axis=0)
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    n = np.zeros_like(t)
    start = np.eye(3)[np.abs(t[0]).argmin()]
    n[0] = start - t[0] * (start @ t[0])
    n[0] /= np.linalg.norm(n[0])
    for i in range(1, len(t)):
        n[i] = n[i - 1] - t[i] * (n[i - 1] @ t[i])
        n[i] /= np.linalg.norm(n[i])
    return t, n, np.cross(t, n)


def straightened(points: DataFrame, vertices: np.ndarray, half_width: float, size: float, most: int = 2000) -> DataFrame:
    """``(s, u, v, n)``: counts along a centre line in the frame of each point's nearest vertex.

    The vertices, a drawn line of bounded length, are literals of one expression.
    """
    if len(vertices) > most:
        raise ValueError(f"a line of more than {most} vertices")
    t, n, b = frames(vertices)
    arc = np.append(0, np.cumsum(np.linalg.norm(np.diff(vertices, axis=0), axis=1)))
    rows = [(k, *map(float, (*vertices[k], *t[k], *n[k], *b[k], arc[k]))) for k in range(len(vertices))]
    names = ["k", *(f"{p}{a}" for p in "ctnb" for a in "xyz"), "arc"]
    line = points.sparkSession.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'k' else 'double'}" for c in names))
    grid = 2 * half_width + float(np.linalg.norm(np.diff(vertices, axis=0), axis=1).max())
    near = line
    for a in "xyz":
        near = near.withColumn(f"g{a}", F.explode(F.sequence(F.floor(F.col(f"c{a}") / grid).cast("long") - 1, F.floor(F.col(f"c{a}") / grid).cast("long") + 1)))
    p = points.select("id", "x", "y", "z", *(F.floor(F.col(a) / grid).cast("long").alias(f"g{a}") for a in "xyz"))
    j = p.join(F.broadcast(near), ["gx", "gy", "gz"])
    d2 = sum(F.pow(F.col(a) - F.col(f"c{a}"), 2) for a in "xyz")
    best = j.groupBy("id").agg(F.min_by(F.struct("x", "y", "z", *names), F.struct(d2, "k")).alias("e")).select("e.*")
    dot = lambda f: sum((F.col(a) - F.col(f"c{a}")) * F.col(f"{f}{a}") for a in "xyz")
    out = best.select((F.col("arc") + dot("t")).alias("s"), dot("n").alias("u"), dot("b").alias("v"))
    out = out.where((F.abs("u") <= half_width) & (F.abs("v") <= half_width))
    return out.groupBy(*(F.floor(F.col(c) / size).cast("long").alias(c) for c in "suv")).agg(F.count(F.lit(1)).alias("n"))


def profile_bins(points: DataFrame, c: str, width: float) -> DataFrame:
    """``(k, v)``: counts along a coordinate by bins, those without a point included."""
    counts = points.groupBy(F.floor(F.col(c) / width).cast("long").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    every = counts.agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("k"))
    return every.join(counts, "k", "left").select("k", F.coalesce("v", F.lit(0.0)).alias("v"))


def smoothed_profile(profile: DataFrame, sigma: float) -> DataFrame:
    """``(k, v)``: Gaussian mean of a profile without gaps, cut at four sigma; beyond its ends it is mirrored."""
    if sigma <= 1e-6:
        return profile.select("k", "v")
    reach = int(4 * sigma + 0.5)
    total = sum(math.exp(-((o / sigma) ** 2) / 2) for o in range(-reach, reach + 1))
    ends = profile.agg(F.min("k").alias("lo"), (F.max("k") - F.min("k") + 1).alias("n"))
    each = profile.select("k").crossJoin(F.broadcast(ends)).withColumn("o", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))  # one row of ends
    turn = F.pmod(F.col("k") - F.col("lo") + F.col("o"), 2 * F.col("n"))
    source = F.col("lo") + F.least(turn, 2 * F.col("n") - 1 - turn)
    taken = each.select("k", source.alias("from"), (F.exp(-F.pow(F.col("o") / sigma, F.lit(2)) / 2) / total).alias("w"))
    return taken.join(profile.select(F.col("k").alias("from"), "v"), "from").groupBy("k").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def detrended(profile: DataFrame, smooth: float, background: float) -> DataFrame:
    """``(k, smooth, detrended)``: a smoothed profile and what is left of it without a wider smoothing, in bins; without a width, without its mean."""
    s = smoothed_profile(profile, smooth).withColumnRenamed("v", "smooth")
    under = smoothed_profile(s.withColumnRenamed("smooth", "v"), background) if background > 1e-6 else s.select("k").crossJoin(F.broadcast(s.agg(F.avg("smooth").alias("v"))))
    return s.join(under, "k").select("k", "smooth", (F.col("smooth") - F.col("v")).alias("detrended"))
