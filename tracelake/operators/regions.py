"""Region records: tables of them, their outlines and conversions, and the rows that they hold."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import geometry as G
from tracelake.operators.filters import Spec, any_of

SCHEMA = "name string, kind string, x0 double, y0 double, x1 double, y1 double, degrees double, points array<struct<x:double,y:double>>, width double, closed boolean"
KINDS = ("rectangle", "oval", "polygon", "freehand", "line", "band", "point", "angle")


@dataclass(frozen=True)
class Region:
    """A region of the plane: bounds for rectangles and ovals, points for the others.

    A line may be closed; a band is all within ``width`` of a line.
    """

    name: str
    kind: str
    x0: float = 0.0
    y0: float = 0.0
    x1: float = 0.0
    y1: float = 0.0
    degrees: float = 0.0
    points: tuple[tuple[float, float], ...] = ()
    width: float = 0.0
    closed: bool = False


def write_regions(spark: SparkSession, regions: Sequence[Region], path: str, mode: str = "error") -> None:
    numbers = ("x0", "y0", "x1", "y1", "degrees", "width")
    rows = [asdict(r) | {k: float(getattr(r, k)) for k in numbers} | {"points": [{"x": float(x), "y": float(y)} for x, y in r.points]} for r in regions]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).json(path)


def read_regions(spark: SparkSession, path: str) -> list[Region]:
    """The regions of a JSON table, drawn by hand and few; an unknown kind is an error."""
    out = []
    for r in spark.read.schema(SCHEMA).json(path).collect():
        if r.kind not in KINDS:
            raise ValueError(f"no region kind {r.kind}")
        out.append(Region(r["name"], r.kind, *(r[k] or 0.0 for k in ("x0", "y0", "x1", "y1", "degrees")), tuple((p.x, p.y) for p in r.points or ()), r.width or 0.0, bool(r.closed)))
    return out


def outline(region: Region, steps: int = 64) -> list[tuple[float, float]]:
    """The vertices of a region's outline; a line's are its own, and so are those of what has points."""
    if region.kind == "band":
        raise ValueError("the outline of a band is round")
    if region.kind not in ("rectangle", "oval"):
        return list(region.points)
    cx, cy = (region.x0 + region.x1) / 2, (region.y0 + region.y1) / 2
    w, h = abs(region.x1 - region.x0) / 2, abs(region.y1 - region.y0) / 2
    if region.kind == "rectangle":
        local = [(-w, -h), (w, -h), (w, h), (-w, h)]
    else:
        local = [(w * math.cos(2 * math.pi * k / steps), h * math.sin(2 * math.pi * k / steps)) for k in range(steps)]
    a = math.radians(region.degrees)
    return [(cx + x * math.cos(a) - y * math.sin(a), cy + x * math.sin(a) + y * math.cos(a)) for x, y in local]


def centre(region: Region) -> tuple[float, float]:
    """The middle of bounds, the vertex of an angle, or the mean of the points."""
    if region.kind in ("rectangle", "oval"):
        return (region.x0 + region.x1) / 2, (region.y0 + region.y1) / 2
    if region.kind == "angle" and len(region.points) > 1:
        return region.points[1]
    n = len(region.points) or 1
    return sum(p[0] for p in region.points) / n, sum(p[1] for p in region.points) / n


def convex(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the points' convex hull, counter-clockwise."""
    rows = sorted(set(points))
    sides = []
    for order in (rows, rows[::-1]):
        side: list[tuple[float, float]] = []
        for q in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]):
                side.pop()
            side.append(q)
        sides += side[:-1]
    return sides or rows


def least_rectangle(points: Sequence[tuple[float, float]]) -> tuple[float, float, float, float, float]:
    """(centre x, centre y, width, height, degrees) of the rectangle of least area around points; one side lies on an edge of the hull."""
    p = np.array(convex(points))
    best = None
    for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0), strict=True):
        a = math.atan2(by - ay, bx - ax)
        turn = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
        low, high = (p @ turn.T).min(0), (p @ turn.T).max(0)
        if best is None or (high - low).prod() < best[0] - 1e-12:
            best = ((high - low).prod(), turn.T @ ((low + high) / 2), high - low, math.degrees(a))
    _, (cx, cy), (w, h), degrees = best
    return float(cx), float(cy), float(w), float(h), degrees


def least_ellipse(points: Sequence[tuple[float, float]], tolerance: float = 1e-7) -> tuple[float, float, float, float, float]:
    """(centre x, centre y, width, height, degrees) of the ellipse of least area around points, a drawn outline's, to a relative tolerance.

    Weights of the points move to the one farthest in the ellipse that they make, until none is beyond it.
    """
    p = np.array(convex(points), float)
    if len(p) < 3:
        (ax, ay), (bx, by) = p[0], p[-1]
        return (ax + bx) / 2, (ay + by) / 2, math.dist(p[0], p[-1]), 0.0, math.degrees(math.atan2(by - ay, bx - ax))
    q = np.vstack([p.T, np.ones(len(p))])
    weight = np.full(len(p), 1 / len(p))
    while True:
        away = np.einsum("ij,ik,kj->j", q, np.linalg.inv((q * weight) @ q.T), q)
        k, j = away.argmax(), np.where(weight > 0, away, np.inf).argmin()
        if away[k] - 3 <= 3 * tolerance and 3 - away[j] <= 3 * tolerance:
            break
        if away[k] - 3 < 3 - away[j]:  # rather take weight from the nearest
            k = j
        step = (away[k] - 3) / (3 * (away[k] - 1))
        step = max(step, -weight[k] / (1 - weight[k])) if weight[k] < 1 else step
        weight *= 1 - step
        weight[k] += step
    c = p.T @ weight
    values, vectors = np.linalg.eigh(2 * ((p.T * weight) @ p - np.outer(c, c)))
    reach = np.sqrt(np.maximum(values, 0)) * math.sqrt(1 + tolerance)
    return float(c[0]), float(c[1]), 2 * float(reach[1]), 2 * float(reach[0]), math.degrees(math.atan2(vectors[1, 1], vectors[0, 1]))


AREAS = ("rectangle", "oval", "polygon", "freehand")
SHAPES = ("bounding_box", "rectangle", "oval", "ellipse")


def conversions(region: Region) -> tuple[str, ...]:
    """What a region can become."""
    if region.kind in AREAS:
        return ("point", *(x for x in SHAPES if x != region.kind), "polygon", "line", *(("convex_hull",) if region.kind in ("polygon", "freehand") else ()))
    return {"line": ("point", "region", *(() if region.closed else ("polygon",))), "angle": ("point",), "point": ("bounding_box", "oval")}.get(region.kind, ())


def converted(region: Region, target: str, width: float | None = None, height: float | None = None) -> Region:
    """As another kind.

    ``point`` is the centre, ``bounding_box`` the upright box, ``rectangle`` the
    one of least area at any angle, ``oval`` the upright ellipse with the box's
    aspect around all of the outline, ``ellipse`` the one of least area;
    ``polygon`` takes the outline, ``convex_hull`` its hull, ``line`` the outline
    as a closed line without an area, ``region`` the band ``width`` wide along a
    line.  A point needs ``width`` and ``height`` for a box or an oval.
    """
    if target not in conversions(region):
        raise ValueError(f"{region.kind} can't become {target}")
    if target == "point":
        return Region(region.name, "point", points=(centre(region),))
    if target == "region":
        if not width or width <= 0:
            raise ValueError("a band needs a positive width")
        return Region(region.name, "band", points=region.points, width=width / 2, closed=region.closed)
    kind = "oval" if target in ("oval", "ellipse") else "rectangle"
    if region.kind == "point":
        if not (width and height and width > 0 and height > 0):
            raise ValueError("a point needs a positive width and height")
        return _around(region, kind, (*centre(region), width, height, 0.0))
    points = outline(region)
    if target in SHAPES and not points or target not in SHAPES and len(points) < 3:
        raise ValueError(f"too few vertices for {target}")
    if target in ("polygon", "convex_hull"):
        return Region(region.name, "polygon", points=tuple(convex(points) if target == "convex_hull" else points))
    if target == "line":
        return Region(region.name, "line", points=tuple(points), closed=True)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    cx, cy, w, h = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, max(xs) - min(xs), max(ys) - min(ys)
    if target == "bounding_box":
        return Region(region.name, kind, min(xs), min(ys), max(xs), max(ys))
    if target == "oval":
        far = max(math.hypot((x - cx) / max(w / 2, 1e-9), (y - cy) / max(h / 2, 1e-9)) for x, y in points)
        return _around(region, kind, (cx, cy, w * far, h * far, 0.0))
    return _around(region, kind, least_rectangle(points) if target == "rectangle" else least_ellipse(points))


def _around(region: Region, kind: str, shape: tuple[float, float, float, float, float]) -> Region:
    cx, cy, w, h, degrees = shape
    return Region(region.name, kind, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, degrees)


def resized(region: Region, distance: float) -> Region:
    """Grown (or shrunk, below zero) by a distance at every side.

    Polygons are scaled about the middle of their box until it has grown by
    that much.  A line can only grow, into a band of that distance; a point
    only into an oval of that diameter.  Angles have no size.
    """
    if not distance or region.kind in ("angle", "band"):
        raise ValueError("no distance" if not distance else f"{region.kind} regions have no size to change")
    if region.kind in ("line", "point") and distance < 0:
        raise ValueError(f"a {region.kind} can only grow")
    if region.kind == "point":
        return _around(region, "oval", (*centre(region), distance, distance, 0.0))
    if region.kind == "line":
        if len(region.points) < 2:
            raise ValueError("a line needs two points")
        return Region(region.name, "band", points=region.points, width=distance, closed=region.closed)
    if region.kind not in ("rectangle", "oval") and len(region.points) < 3:
        raise ValueError("a polygon needs three vertices")
    xs, ys = zip(*(region.points or ((region.x0, region.y0), (region.x1, region.y1))), strict=True)
    w, h = max(xs) - min(xs), max(ys) - min(ys)
    scale = [(v + 2 * distance) / v if v > 0 else 1.0 for v in (w, h)]
    if min(scale) <= 0 or region.kind in ("rectangle", "oval") and min(w, h) + 2 * distance <= 0:
        raise ValueError("nothing would be left of the region")
    if region.kind in ("rectangle", "oval"):
        return replace(region, x0=min(xs) - distance, y0=min(ys) - distance, x1=max(xs) + distance, y1=max(ys) + distance)
    cx, cy = (max(xs) + min(xs)) / 2, (max(ys) + min(ys)) / 2
    return replace(region, points=tuple((cx + (x - cx) * scale[0], cy + (y - cy) * scale[1]) for x, y in region.points))


def holds(region: Region, x: Column, y: Column) -> Column:
    if region.kind == "rectangle":
        return G.in_rectangle(x, y, region.x0, region.y0, region.x1, region.y1, region.degrees)
    if region.kind == "oval":
        return G.in_oval(x, y, region.x0, region.y0, region.x1, region.y1, region.degrees)
    if region.kind == "band":
        return near_line([*region.points, *(region.points[:1] if region.closed else ())], region.width, x, y)
    return G.in_polygon(x, y, region.points) if region.kind in AREAS else F.lit(False)


def combined(regions: Sequence[Region], x: Column, y: Column) -> Column:
    """Rows of the union of regions."""
    return any_of([holds(r, x, y) for r in regions])


def near_line(points: Sequence[tuple[float, float]], width: float, x: Column, y: Column) -> Column:
    """Rows within ``width`` of a polyline: the band around it with round ends."""
    inside = []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / square, F.lit(0.0)), F.lit(1.0)) if square else F.lit(0.0)
        inside.append(F.pow(x - ax - t * dx, 2) + F.pow(y - ay - t * dy, 2) <= width * width)
    return any_of(inside)


def crop_specs(region: Region, x: str = "x", y: str = "y", z: tuple[str, float, float] | None = None) -> list[Spec]:
    """An upright rectangle as range specs, which can be evaluated again on any rows and reach the scan."""
    if region.kind != "rectangle" or region.degrees:
        raise ValueError("only an upright rectangle can be written as ranges")
    lo_x, hi_x, lo_y, hi_y = min(region.x0, region.x1), max(region.x0, region.x1), min(region.y0, region.y1), max(region.y0, region.y1)
    return [Spec(x, "loc", lo_x, hi_x), Spec(y, "loc", lo_y, hi_y), *([Spec(z[0], "loc", z[1], z[2])] if z else [])]


def boxes(points: DataFrame, key: str = "tid") -> DataFrame:
    """The upright box around each group of points as a table of rectangles."""
    return points.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def within(regions: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Regions whose box lies inside an extent."""
    return regions.where((F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1))


def enclosing_ellipse(points: DataFrame, key: str = "tid") -> DataFrame:
    """``(key, cx, cy, rx, ry)``: the ellipse with the aspect of a group's box that just covers all of its points; a flat box counts as 1e-9 wide."""
    box = boxes(points, key).select(
        F.col(key).alias("k"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), ((F.col("x1") - F.col("x0")) / 2).alias("w"), ((F.col("y1") - F.col("y0")) / 2).alias("h")
    )
    far = F.sqrt(F.pow((F.col("x") - F.col("cx")) / F.greatest("w", F.lit(1e-9)), 2) + F.pow((F.col("y") - F.col("cy")) / F.greatest("h", F.lit(1e-9)), 2))
    grown = points.join(box, points[key].eqNullSafe(box["k"])).groupBy(key).agg(F.max(far).alias("s"), *(F.first(c).alias(c) for c in ("cx", "cy", "w", "h")))
    return grown.select(key, "cx", "cy", (F.col("w") * F.col("s")).alias("rx"), (F.col("h") * F.col("s")).alias("ry"))


def labelled(points: DataFrame, labels: DataFrame, size: float) -> DataFrame:
    """Points with the label of their pixel, from a label raster ``(ix, iy, label)``; null outside of it."""
    at = points.withColumn("ix", F.floor(F.col("x") / size)).withColumn("iy", F.floor(F.col("y") / size))
    return at.join(labels, ["ix", "iy"], "left")


def snapped(pixels: DataFrame, cursors: DataFrame, window: int = 7, rounds: int = 3, tolerance: float = 1e-3) -> DataFrame:
    """``(id, col, row)``: cursors moved to the centre of mass of the pixels in a square around them, ``rounds`` times or until they rest.

    pixels: (ix, iy, v), none where there is nothing.  cursors: (id, col, row),
    and dx, dy where a cursor may only move across that direction.  A cursor
    with an empty square stays.  Cursors meet pixels by an equi join.
    """
    half = max(1, window // 2)
    at = cursors.select("id", F.col("col").cast("double").alias("col"), F.col("row").cast("double").alias("row"), *(F.col(c).cast("double").alias(c) if c in cursors.columns else F.lit(0.0).alias(c) for c in ("dx", "dy")), F.lit(True).alias("moves"))
    for _ in range(max(1, rounds)):
        middle = {c: F.bround(c).cast("long") for c in ("col", "row")}
        seen = at.where("moves").select("id", F.explode(F.sequence(middle["col"] - half, middle["col"] + half)).alias("ix"), middle["row"].alias("r"))
        seen = seen.select("id", "ix", F.explode(F.sequence(F.col("r") - half, F.col("r") + half)).alias("iy"))
        mass = seen.join(pixels, ["ix", "iy"]).groupBy("id").agg(F.sum("v").alias("m"), F.sum(F.col("v") * F.col("ix")).alias("mx"), F.sum(F.col("v") * F.col("iy")).alias("my")).where("m > 0")
        met = at.join(mass, "id", "left")
        sx, sy = F.col("mx") / F.col("m") - F.col("col"), F.col("my") / F.col("m") - F.col("row")
        norm = F.hypot("dx", "dy")
        along = F.when(norm > 1e-9, (sx * F.col("dx") + sy * F.col("dy")) / (norm * norm)).otherwise(0.0)
        sx, sy = F.coalesce(sx - along * F.col("dx"), F.lit(0.0)), F.coalesce(sy - along * F.col("dy"), F.lit(0.0))
        at = met.select("id", (F.col("col") + sx).alias("col"), (F.col("row") + sy).alias("row"), "dx", "dy", (F.col("moves") & (F.abs(sx) + F.abs(sy) >= tolerance)).alias("moves"))
    return at.select("id", "col", "row")
