"""Particles: small re-centred clouds, keyed by ``particle``, with ``x y z``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.spatial import near_pairs, squared


def centred(df: DataFrame, axes=("x", "y", "z")) -> DataFrame:
    w = Window.partitionBy("particle")
    for a in axes:
        df = df.withColumn(a, F.col(a) - F.avg(a).over(w))
    return df


def pooled(df: DataFrame, matrices: DataFrame) -> DataFrame:
    """Every particle moved by its own 4x4 matrix ``(particle, m)``, m a list of 16 row by row."""
    j = df.join(matrices, "particle")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    row = lambda k: F.col("m")[4 * k] * x + F.col("m")[4 * k + 1] * y + F.col("m")[4 * k + 2] * z + F.col("m")[4 * k + 3]
    return j.select("particle", row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))


def symmetrized(df: DataFrame, fold: int) -> DataFrame:
    """``fold`` turned copies of every point."""
    k = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(fold - 1)))).withColumn("__a", F.col("__k") * (2 * math.pi / fold))
    c, s = F.cos("__a"), F.sin("__a")
    return k.withColumn("__x", F.col("x") * c - F.col("y") * s).withColumn("y", F.col("x") * s + F.col("y") * c).withColumn("x", F.col("__x")).drop("__x", "__a", "__k")


def collapse_traces(df: DataFrame, axes=("x", "y", "z")) -> DataFrame:
    """One mean point per trace and particle; a particle of one trace, or of single rows only, stays as it is."""
    per = df.groupBy("particle", "tid").agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(a) for a in axes))
    s = per.groupBy("particle").agg(F.count(F.lit(1)).alias("traces"), F.max("n").alias("most"))
    keep = s.where("traces <= 1 OR most <= 1").select("particle")
    return per.join(keep, "particle", "left_anti").select("particle", "tid", *axes).unionByName(df.join(keep, "particle", "left_semi").select("particle", "tid", *axes))


def overlap(df: DataFrame, a: int, b: int, sigma: float) -> DataFrame:
    """One row: summed Gaussian overlap of two particles' points, over pairs within 8 sigma by x and by y."""
    one, two = (df.where(F.col("particle") == p).select("x", "y", "z") for p in (a, b))
    within = near_pairs(one, two, 12 * sigma).where((F.abs(F.col("a.x") - F.col("b.x")) <= 8 * sigma) & (F.abs(F.col("a.y") - F.col("b.y")) <= 8 * sigma))
    return within.agg(F.coalesce(F.sum(F.exp(-squared("xyz") / (4 * sigma**2))), F.lit(0.0)).alias("overlap"))


def aligned(df: DataFrame, template: np.ndarray, pixel: float, angles: int = 36) -> DataFrame:
    """Each particle turned and moved onto a template image: ``(particle, x, y, angle, score)``.

    A particle is a bounded cloud; each is handled in its own group.
    """
    side = template.shape[0]
    spectrum = np.fft.rfft2(template).conj()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy() - pdf[["x", "y"]].to_numpy().mean(0)
        best = (-np.inf, 0.0, 0, 0)
        for k in range(angles):
            a = 2 * math.pi * k / angles
            q = p @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
            i = np.floor(q / pixel + side / 2).astype(int)
            i = i[((i >= 0) & (i < side)).all(axis=1)]
            image = np.zeros((side, side))
            np.add.at(image, (i[:, 1], i[:, 0]), 1.0)
            c = np.fft.irfft2(np.fft.rfft2(image).conj() * spectrum.conj(), (side, side))
            y, x = np.unravel_index(c.argmax(), c.shape)
            if c.max() > best[0]:
                best = (float(c.max()), a, (x + side // 2) % side - side // 2, (y + side // 2) % side - side // 2)
        score, a, dx, dy = best
        q = p @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + np.array([dx, dy]) * pixel
        return pd.DataFrame({"particle": pdf["particle"], "x": q[:, 0], "y": q[:, 1], "angle": a, "score": score / max(len(p), 1)})

    return df.groupBy("particle").applyInPandas(fit, "particle long, x double, y double, angle double, score double")


def image_of(df: DataFrame, pixel: float, side: int) -> np.ndarray:
    """Pooled points as a counts image: at most side * side rows."""
    i = {a: F.floor(F.col(a) / pixel + side / 2).cast("int") for a in "xy"}
    rows = df.select(i["x"].alias("i"), i["y"].alias("j")).where(f"i >= 0 AND i < {side} AND j >= 0 AND j < {side}").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros((side, side))
    for r in rows:
        out[r["j"], r["i"]] = r["n"]
    return out


def averaged(df: DataFrame, pixel: float, side: int, template: np.ndarray | None = None, rounds: int = 5, tolerance: float = 0.01) -> DataFrame:
    """Particles aligned to a template, or to their own average round by round until it stays the same."""
    from tracelake.storage import stored

    if template is not None:
        return aligned(df, template, pixel)
    now = image_of(centred(df, ("x", "y")), pixel, side)
    for _ in range(rounds):
        out = stored(aligned(df, now, pixel), "aligned-particles")
        new = image_of(out, pixel, side)
        change = np.abs(new - now).sum() / max(np.abs(now).sum(), 1e-300)
        now = new
        if change < tolerance:
            break
    return out


def hull(df: DataFrame, key: str = "particle") -> DataFrame:
    """``(key, k, x, y)``: the convex hull of each group, counter-clockwise; a group is pre-reduced to extreme points by sector.

    Of each direction only the farthest point can be a corner there, so every
    task first keeps the corners of its own rows.
    """

    def chain(points: np.ndarray) -> np.ndarray:
        p = np.unique(points, axis=0)
        if len(p) < 3:
            return p

        def half(rows):
            out: list = []
            for q in rows:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out

        low, high = half(p), half(p[::-1])
        return np.array(low[:-1] + high[:-1])

    def own(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key, sort=False):
                c = chain(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({key: k, "x": c[:, 0], "y": c[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        c = chain(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "k": range(len(c)), "x": c[:, 0], "y": c[:, 1]})

    kind = df.schema[key].dataType.simpleString()
    reduced = df.select(key, F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(own, f"{key} {kind}, x double, y double")
    return reduced.groupBy(key).applyInPandas(whole, f"{key} {kind}, k long, x double, y double")


def hull_shapes(hulls: DataFrame, key: str = "particle") -> DataFrame:
    """``(key, area, rect_area, rect_angle, cx, cy, radius)``: hull area, least-area rectangle and least circle of each hull."""

    def circle(p: np.ndarray) -> tuple[float, float, float]:
        def by(*q):
            if len(q) == 1:
                return (*q[0], 0.0)
            if len(q) == 2:
                c = (q[0] + q[1]) / 2
                return (*c, float(np.linalg.norm(q[0] - c)))
            (ax, ay), (bx, by_), (cx, cy) = q
            d = 2 * (ax * (by_ - cy) + bx * (cy - ay) + cx * (ay - by_))
            if abs(d) < 1e-12:
                return max((by(u, v) for u, v in ((q[0], q[1]), (q[0], q[2]), (q[1], q[2]))), key=lambda t: t[2])
            u = ((ax**2 + ay**2) * (by_ - cy) + (bx**2 + by_**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by_)) / d
            v = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by_**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
            return u, v, float(np.hypot(ax - u, ay - v))

        def outside(t, q):
            return np.hypot(q[0] - t[0], q[1] - t[1]) > t[2] * (1 + 1e-12) + 1e-12

        best = by(p[0])
        for i in range(1, len(p)):
            if outside(best, p[i]):
                best = by(p[i])
                for j in range(i):
                    if outside(best, p[j]):
                        best = by(p[i], p[j])
                        for k in range(j):
                            if outside(best, p[k]):
                                best = by(p[i], p[j], p[k])
        return tuple(float(v) for v in best)

    def shapes(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("k")[["x", "y"]].to_numpy()
        q = np.roll(p, -1, axis=0)
        area = abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2)
        best = (float("inf"), 0.0)
        for a in np.unique(np.arctan2(*(q - p).T[::-1])):
            t = p @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
            best = min(best, (float(np.prod(t.max(0) - t.min(0))), float(a)))
        cx, cy, radius = circle(p)
        return pd.DataFrame([{key: pdf[key].iloc[0], "area": area, "rect_area": best[0], "rect_angle": best[1], "cx": cx, "cy": cy, "radius": radius}])

    kind = hulls.schema[key].dataType.simpleString()
    return hulls.groupBy(key).applyInPandas(shapes, f"{key} {kind}, area double, rect_area double, rect_angle double, cx double, cy double, radius double")
