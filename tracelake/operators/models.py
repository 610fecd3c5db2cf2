"""Mixture models, spectra and resolution from aggregated rows.

Values are first reduced to a bounded histogram (``bins`` rows) by Spark; the
iterations then run over those rows, so their cost doesn't grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number
from tracelake.operators.histogram import histogram


def binned(df: DataFrame, value: str, bins: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Bin centres and counts: at most ``bins`` rows reach the driver."""
    rows = histogram(df, value, bins).orderBy("bin").collect()
    return np.array([(r["lo"] + r["hi"]) / 2 for r in rows]), np.array([r["n"] for r in rows], dtype=float)


def _log_pdf(kind: str, x: np.ndarray, a: float, b: float) -> np.ndarray:
    if kind == "gaussian":
        return -0.5 * ((x - a) / b) ** 2 - math.log(b * math.sqrt(2 * math.pi))
    if kind == "lognormal":
        with np.errstate(divide="ignore", invalid="ignore"):
            lx = np.log(x)
            return np.where(x > 0, -0.5 * ((lx - a) / b) ** 2 - lx - math.log(b * math.sqrt(2 * math.pi)), -np.inf)
    if kind == "gamma":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, (a - 1) * np.log(x) - x / b - math.lgamma(a) - a * math.log(b), -np.inf)
    if kind == "poisson":
        k = np.round(x)
        return k * math.log(max(a, 1e-12)) - a - np.array([math.lgamma(v + 1) for v in np.maximum(k, 0)])
    raise ValueError(f"no distribution {kind!r}")


def _update(kind: str, x: np.ndarray, w: np.ndarray, floor: float) -> tuple[float, float]:
    total = max(w.sum(), 1e-300)
    if kind == "lognormal":
        x, w = np.log(x[x > 0]), w[x > 0]
        total = max(w.sum(), 1e-300)
    mean = float((w * x).sum() / total)
    var = max(float((w * (x - mean) ** 2).sum() / total), floor**2)
    if kind == "gamma":
        return max(mean * mean / var, 1e-6), var / max(mean, 1e-12)
    return (mean, 0.0) if kind == "poisson" else (mean, math.sqrt(var))


def fit_mixture(x: np.ndarray, n: np.ndarray, k: int, kind: str = "gaussian", starts: int = 5, steps: int = 300) -> dict:
    """EM over weighted values, best of several starts: weights, parameters, log-likelihood and BIC."""
    if kind in ("lognormal", "gamma"):
        x, n = x[x > 0], n[x > 0]
    total, spread = n.sum(), math.sqrt(max(np.average((x - np.average(x, weights=n)) ** 2, weights=n), 1e-12))
    unit = spread if kind != "lognormal" else max(float(np.std(np.log(x))), 1e-6)
    floor = 1e-3 * unit
    cum = np.cumsum(n) / total
    best = None
    for s in range(starts):
        shares = (np.arange(k) + 0.5) / k if s == 0 else np.sort(np.random.default_rng(s).uniform(0.02, 0.98, k))
        centres = x[np.minimum(np.searchsorted(cum, shares), len(x) - 1)]
        if kind == "gamma":
            params = [((c / spread) ** 2 * k * k + 1e-6, spread**2 / (k * k * c)) for c in np.maximum(centres, 1e-9)]
        elif kind == "lognormal":
            params = [(math.log(c), unit / k) for c in centres]
        else:
            params = [(float(c), spread / k) for c in centres]
        weights, before = np.full(k, 1 / k), -np.inf
        for _ in range(steps):
            logs = np.array([math.log(max(w, 1e-300)) + _log_pdf(kind, x, *p) for w, p in zip(weights, params, strict=True)])
            top = logs.max(axis=0)
            dens = top + np.log(np.exp(logs - top).sum(axis=0))
            like = float((n * dens).sum())
            post = np.exp(logs - dens) * n
            weights = post.sum(axis=1) / total
            params = [_update(kind, x, p, floor) for p in post]
            if abs(like - before) <= 1e-8 * abs(like):
                break
            before = like
        if best is None or like > best["loglik"]:
            order = np.argsort([p[0] * (p[1] if kind == "gamma" else 1) for p in params])
            free = k * (1 if kind == "poisson" else 2) + k - 1
            best = {"kind": kind, "weights": [float(weights[i]) for i in order], "params": [params[i] for i in order], "loglik": like, "bic": free * math.log(total) - 2 * like}
    return best


def search_mixture(x: np.ndarray, n: np.ndarray, kinds: Sequence[str] = ("gaussian", "lognormal", "gamma"), most: int = 4) -> dict:
    """The fit of least BIC; components are added as long as that improves."""
    best = None
    for kind in kinds:
        last = None
        for k in range(1, most + 1):
            fit = fit_mixture(x, n, k, kind)
            if last is not None and fit["bic"] >= last["bic"]:
                break
            last = fit
        if best is None or last["bic"] < best["bic"]:
            best = last
    return best


def equal_population(df: DataFrame, value: str, parts: int) -> DataFrame:
    """``(part, cut)``: cut points of equally filled parts."""
    shares = [i / parts for i in range(parts + 1)]
    q = df.agg(F.percentile(number(value), F.array(*map(F.lit, shares))).alias("q"))
    return q.select(F.posexplode("q").alias("part", "cut"))


def period_spectrum(profile: DataFrame, step: float, periods: Sequence[float]) -> DataFrame:
    """``(period, power)`` of a Hann-windowed profile ``(bin, n)`` with its mean taken off; one term a bin and period."""
    s = profile.agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.sum("n").alias("t")).withColumn("k", F.col("b1") - F.col("b0") + 1)
    full = s.select(F.explode(F.sequence("b0", "b1")).alias("bin"), "b0", "k", (F.col("t") / F.col("k")).alias("mean"))  # empty bins count 0
    v = F.coalesce("n", F.lit(0)) - F.col("mean")
    hann = 0.5 - 0.5 * F.cos(2 * F.pi() * (F.col("bin") - F.col("b0")) / (F.col("k") - 1))
    rows = full.join(profile, "bin", "left").select(((F.col("bin") - F.col("b0")) * step).alias("at"), (v * hann).alias("v"))
    each = rows.withColumn("period", F.explode(F.array(*(F.lit(float(p)) for p in periods))))
    turn = 2 * F.pi() * F.col("at") / F.col("period")
    return each.groupBy("period").agg((F.pow(F.sum(F.col("v") * F.cos(turn)), 2) + F.pow(F.sum(F.col("v") * F.sin(turn)), 2)).alias("power"))


def autocorrelation(profile: DataFrame, lags: int) -> DataFrame:
    """``(lag, r)``: mean product of a profile ``(bin, n)`` with itself a lag further on, over the mean square."""
    m = profile.agg(F.avg("n").alias("m"))
    c = profile.crossJoin(F.broadcast(m)).select("bin", (F.col("n") - F.col("m")).alias("v"))
    ahead = c.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lags).cast("long"))).alias("lag"), F.col("bin").alias("other"), F.col("v").alias("u"))
    ahead = ahead.select("lag", (F.col("other") - F.col("lag")).alias("bin"), "u")
    pairs = c.join(ahead, "bin").groupBy("lag").agg(F.avg(F.col("v") * F.col("u")).alias("r"))
    zero = pairs.where("lag = 0").select(F.col("r").alias("r0"))
    return pairs.crossJoin(F.broadcast(zero)).select("lag", (F.col("r") / F.col("r0")).alias("r"))


def half_width(profile: DataFrame) -> DataFrame:
    """``(width)``: distance between the half-maximum crossings of a profile ``(x, v)``, by linear interpolation."""
    rows = profile.orderBy("x").collect()  # a profile: some hundred rows
    x, v = np.array([r["x"] for r in rows], dtype=float), np.array([r["v"] for r in rows], dtype=float)
    spark = profile.sparkSession
    if not len(v) or v.max() <= v.min():
        return spark.createDataFrame([(None,)], "width double")
    half, top = (v.max() + v.min()) / 2, int(v.argmax())
    cross = lambda i, j: x[i] + (half - v[i]) * (x[j] - x[i]) / (v[j] - v[i])
    left = next((cross(i - 1, i) for i in range(top, 0, -1) if v[i - 1] < half <= v[i]), x[0])
    right = next((cross(i, i + 1) for i in range(top, len(v) - 1) if v[i + 1] < half <= v[i]), x[-1])
    return spark.createDataFrame([(float(right - left),)], "width double")


def symmetry(points: DataFrame, most: int = 12, bins: int = 72, core: float = 0.3) -> DataFrame:
    """``(fold, power)`` of the angles around the centre; points inside ``core`` median radii are left out."""
    c = points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    p = points.crossJoin(F.broadcast(c)).select((F.col("x") - F.col("cx")).alias("dx"), (F.col("y") - F.col("cy")).alias("dy"))
    p = p.withColumn("rad", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    m = p.agg(F.percentile("rad", 0.5).alias("m"))
    angle = F.atan2("dy", "dx")
    hist = p.crossJoin(F.broadcast(m)).where(F.col("rad") >= core * F.col("m")).groupBy(F.floor((angle / (2 * F.pi()) + 0.5) * bins).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    each = hist.withColumn("fold", F.explode(F.sequence(F.lit(2), F.lit(most))))
    turn = 2 * F.pi() * (F.col("b") + 0.5) / bins * F.col("fold")
    total = F.sum("n")
    return each.groupBy("fold").agg((F.sqrt(F.pow(F.sum(F.col("n") * F.cos(turn)), 2) + F.pow(F.sum(F.col("n") * F.sin(turn)), 2)) / total).alias("power"))


def ring_correlation(points: DataFrame, pixel: float, repeats: int = 4, max_side: int = 4096) -> DataFrame:
    """``(ring, frc)``: Fourier ring correlation of random halves, averaged over repeats.

    Halves come from a hash of id and repeat, so they are the same each time.
    The raster of each repeat (its occupied pixels, side bounded) goes to one
    task, which needs the whole image for its transform.
    """
    e = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    side = int(max((e["x1"] - e["x0"]) // pixel, (e["y1"] - e["y0"]) // pixel)) + 1
    if side > max_side:
        raise ValueError(f"{side} pixels a side; the limit is {max_side}: take larger pixels or a region")
    each = points.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("half", F.pmod(F.xxhash64("id", "rep"), F.lit(2)))
    px = each.groupBy("rep", "half", F.floor((F.col("x") - e["x0"]) / pixel).cast("int").alias("ix"), F.floor((F.col("y") - e["y0"]) / pixel).cast("int").alias("iy")).agg(F.count(F.lit(1)).alias("n"))

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        images = np.zeros((2, side, side))
        np.add.at(images, (pdf["half"].to_numpy(), pdf["iy"].to_numpy(), pdf["ix"].to_numpy()), pdf["n"].to_numpy())
        window = np.hanning(side + 2)[1:-1]
        a, b = (np.fft.rfft2(i * window[:, None] * window[None, :]) for i in images)
        f = np.hypot(np.fft.fftfreq(side)[:, None], np.fft.rfftfreq(side)[None, :])
        ring = np.rint(f * side).astype(int).ravel()
        sums = [np.bincount(ring, v.ravel()) for v in ((a * b.conj()).real, abs(a) ** 2, abs(b) ** 2)]
        frc = sums[0] / np.sqrt(np.maximum(sums[1] * sums[2], 1e-300))
        return pd.DataFrame({"ring": np.arange(len(frc)), "frc": frc})[: side // 2]

    return px.groupBy("rep").applyInPandas(correlate, "ring long, frc double").groupBy("ring").agg(F.avg("frc").alias("frc"))


def resolution(curve: DataFrame, pixel: float, side: int, threshold: float = 1 / 7, smooth: int = 3) -> float | None:
    """The length at which the curve first falls below the threshold; None if it doesn't."""
    rows = curve.orderBy("ring").collect()  # half the image's side
    v = np.array([r["frc"] for r in rows])
    v = np.convolve(v, np.ones(smooth) / smooth, mode="same")
    below = [k for k in range(1, len(v)) if v[k] < threshold]
    return side * pixel / below[0] if below else None


def drift(points: DataFrame, window: float, pixel: float, max_windows: int = 400, max_shift: int = 40) -> DataFrame:
    """``(w, dx, dy)``: drift of each full time window against the first, by least squares over all pairs' shifts.

    Every window is rastered by Spark; pairs of windows are rows of a small
    table, correlated in their own tasks; the shifts (one row a pair) are solved
    as one linear system with a smoothness term.
    """
    e = points.agg(F.min("tim").alias("t0"), F.max("tim").alias("t1"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    count = int((e["t1"] - e["t0"]) // window)
    if not 2 <= count <= max_windows:
        raise ValueError(f"{count} full windows; 2 to {max_windows} are needed")
    side = int(max(e["x1"] - e["x0"], e["y1"] - e["y0"]) // pixel) + 1
    w = F.floor((F.col("tim") - e["t0"]) / window).cast("int")
    px = points.withColumn("w", w).where(F.col("w") < count).groupBy("w", F.floor((F.col("x") - e["x0"]) / pixel).cast("int").alias("ix"), F.floor((F.col("y") - e["y0"]) / pixel).cast("int").alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    images = px.groupBy("w").agg(F.collect_list("ix").alias("ix"), F.collect_list("iy").alias("iy"), F.collect_list("n").alias("n"))
    a, b = images.select(*(F.col(c).alias(f"a_{c}") for c in images.columns)), images.select(*(F.col(c).alias(f"b_{c}") for c in images.columns))
    pairs = a.join(b, F.col("a_w") < F.col("b_w"))  # windows, bounded by max_windows

    def shifts(batches):
        def image(r, k):
            out = np.zeros((side, side))
            np.add.at(out, (r[f"{k}_iy"], r[f"{k}_ix"]), r[f"{k}_n"])
            return out

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                shape = (2 * side, 2 * side)
                c = np.fft.irfft2(np.fft.rfft2(image(r, "b"), shape) * np.fft.rfft2(image(r, "a"), shape).conj(), shape)
                c = np.roll(c, (max_shift, max_shift), (0, 1))[: 2 * max_shift + 1, : 2 * max_shift + 1]
                y, x = np.unravel_index(c.argmax(), c.shape)
                ys, xs = slice(max(y - 2, 0), y + 3), slice(max(x - 2, 0), x + 3)
                part = np.maximum(c[ys, xs] - np.median(c), 0)
                gy, gx = np.mgrid[ys, xs]
                total = max(part.sum(), 1e-300)
                rows.append((r["a_w"], r["b_w"], ((gx * part).sum() / total - max_shift) * pixel, ((gy * part).sum() / total - max_shift) * pixel, float(c.max())))
            yield pd.DataFrame(rows, columns=["a", "b", "dx", "dy", "weight"])

    found = pairs.mapInPandas(shifts, "a int, b int, dx double, dy double, weight double").collect()  # one row a pair of windows
    matrix, right = np.zeros((len(found) + count, count)), np.zeros((len(found) + count, 2))
    scale = max(r["weight"] for r in found)
    for i, r in enumerate(found):
        s = math.sqrt(max(r["weight"] / scale, 1e-6))
        matrix[i, r["b"]], matrix[i, r["a"]] = s, -s
        right[i] = s * r["dx"], s * r["dy"]
    for i in range(1, count - 1):
        matrix[len(found) + i, i - 1 : i + 2] = 0.05 * np.array([1, -2, 1])
    matrix[-1, 0] = 1.0
    solved = np.linalg.lstsq(matrix, right, rcond=None)[0]
    solved = solved - solved[0]
    return points.sparkSession.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(solved)], "w int, dx double, dy double")


def without_drift(points: DataFrame, found: DataFrame, window: float) -> DataFrame:
    """Points minus the drift, interpolated between window centres and held at both ends."""
    rows = found.orderBy("w").collect()  # at most max_windows
    t0 = points.agg(F.min("tim")).first()[0]
    place = (F.col("tim") - t0) / window - 0.5
    k = F.greatest(F.lit(0), F.least(F.floor(place).cast("int"), F.lit(len(rows) - 2)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place - k))
    out = points
    for axis in ("x", "y"):
        values = F.array(*(F.lit(r[f"d{axis}"]) for r in rows))
        at = F.get(values, k) * (1 - t) + F.get(values, k + 1) * t
        out = out.withColumn(axis, F.col(axis) - at)
    return out
