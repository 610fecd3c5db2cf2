"""Column algebra: transforms, shapes, densities and text helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def homogeneous(matrix: Sequence[Sequence[float]], x: Column, y: Column, z: Column | None = None) -> tuple[Column, ...]:
    """A 3x3 (plane) or 4x4 (space) homogeneous matrix applied to coordinates."""
    axes = [x, y] if len(matrix) == 3 else [x, y, z]
    out = []
    for row in matrix[: len(axes)]:
        total = F.lit(float(row[-1]))
        for m, c in zip(row, axes, strict=False):
            total = total + F.lit(float(m)) * c
        out.append(total)
    return tuple(out) if len(matrix) == 4 or z is None else (*out, z)


def rotated(x: Column, y: Column, cx: float, cy: float, degrees: float) -> tuple[Column, Column]:
    """Coordinates in a frame centred at (cx, cy) and turned by ``degrees``."""
    a = math.radians(degrees)
    dx, dy = x - cx, y - cy
    return dx * math.cos(a) + dy * math.sin(a), dy * math.cos(a) - dx * math.sin(a)


def in_rectangle(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float, degrees: float = 0.0) -> Column:
    lo_x, hi_x, lo_y, hi_y = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    if not degrees:
        return x.between(lo_x, hi_x) & y.between(lo_y, hi_y)
    u, v = rotated(x, y, (lo_x + hi_x) / 2, (lo_y + hi_y) / 2, degrees)
    return (F.abs(u) <= (hi_x - lo_x) / 2) & (F.abs(v) <= (hi_y - lo_y) / 2)


def in_oval(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float, degrees: float = 0.0) -> Column:
    u, v = rotated(x, y, (x0 + x1) / 2, (y0 + y1) / 2, degrees)
    return F.pow(u / (abs(x1 - x0) / 2), 2) + F.pow(v / (abs(y1 - y0) / 2), 2) <= 1


def in_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule: the parity of the edges that a ray to the right crosses."""
    inside = F.lit(False)
    for (vx, vy), (wx, wy) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if vy != wy:
            crosses = ((F.lit(vy) > y) != (F.lit(wy) > y)) & (x < (wx - vx) * (y - vy) / (wy - vy) + vx)
            inside = inside != crosses
    return inside


def normal_pdf(v: Column, mean: float, sigma: float) -> Column:
    return F.exp(-F.pow((v - mean) / sigma, 2) / 2) / (sigma * math.sqrt(2 * math.pi))


def maxwell_pdf(d: Column, sigma: float) -> Column:
    """Distance density of a three-dimensional Gaussian offset."""
    return math.sqrt(2 / math.pi) * d * d / sigma**3 * F.exp(-d * d / (2 * sigma**2))


def offset_pdf(d: Column, separation: float, sigma: float) -> Column:
    """Distance density for a fixed separation blurred in three dimensions."""
    near = F.exp(-F.pow(d - separation, 2) / (2 * sigma**2)) - F.exp(-F.pow(d + separation, 2) / (2 * sigma**2))
    return d / (separation * sigma * math.sqrt(2 * math.pi)) * near


def responsibilities(v: Column, components: Sequence[tuple[float, float, float]]) -> list[Column]:
    """Posterior of each (weight, mean, sigma) component."""
    parts = [w * normal_pdf(v, m, s) for w, m, s in components]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def posterior_label(v: Column, components: Sequence[tuple[float, float, float]], min_confidence: float) -> Column:
    """The component of largest posterior, -1 below the confidence or for missing values."""
    posts = responsibilities(v, components)
    best = F.greatest(*posts) if len(posts) > 1 else posts[0]
    label = F.lit(-1)
    for k, p in reversed(list(enumerate(posts))):
        label = F.when(p == best, k).otherwise(label)
    return F.when(v.isNotNull() & ~F.isnan(v) & (best >= min_confidence), label).otherwise(-1)


def decision_boundary(a: tuple[float, float, float], b: tuple[float, float, float]) -> float | None:
    """Where two weighted Gaussians (weight, mean, sigma) cross, between their means if there."""
    (w1, m1, s1), (w2, m2, s2) = a, b
    qa, qb = 1 / s2**2 - 1 / s1**2, 2 * (m1 / s1**2 - m2 / s2**2)
    qc = m2**2 / s2**2 - m1**2 / s1**2 + 2 * math.log((w1 * s2) / (w2 * s1))
    if abs(qa) < 1e-12:
        return None if abs(qb) < 1e-12 else -qc / qb
    disc = qb * qb - 4 * qa * qc
    if disc < 0:
        return None
    found = sorted(((-qb + s * math.sqrt(disc)) / (2 * qa) for s in (1, -1)), key=lambda r: abs(r - (m1 + m2) / 2))
    return next((r for r in found if min(m1, m2) <= r <= max(m1, m2)), found[0])


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th and so on."""
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def header_key(name: Column) -> Column:
    """A column header in lower case, without units in brackets and without marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[\\(\\[].*?[\\)\\]]", ""), "[^a-z0-9]+", "")


def header_unit(name: Column) -> Column:
    """The length or time unit named in a header, empty without one."""
    return F.regexp_extract(F.lower(name), "(?:[\\(\\[_ ])(nm|um|mm|px|pixel|ms|s|m)(?:[\\)\\]]|$)", 1)


def mask_key(*parts: str) -> Column:
    return F.concat(F.lit("mask_"), F.substring(F.sha2(F.lit("|".join(parts)), 256), 1, 12))


def tilt(edge: Column, half_width: Column) -> Column:
    """Degrees between a rod's surface and the image plane, from the distance to the rod's projected edge and its half width; null without a width."""
    return F.when(half_width > 0, F.degrees(F.asin(F.least(F.greatest(1 - edge / half_width, F.lit(0.0)), F.lit(1.0)))))
