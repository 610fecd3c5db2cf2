"""Skeleton pixels as paths: the pixel graph contracted by pointer jumping.

Pixels with other than two neighbours are nodes; between them run branches.  A
step from one pixel to a neighbour is followed by one other step unless it ends
at a node.  All steps find the end of their branch at once: in each round a step
takes over where the step that it points at points, so the distance doubles and
a branch of any length, across any number of tiles, needs few rounds of one
join.  A step's place in its branch is the distance that the opposite step has
to go.  Rings without a node are cut at their smallest pixel first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.graph import components
from tracelake.storage import release, stored

#: Pixel indexes lie within this many of zero, so that a pixel is one long.
SPAN = 1 << 30


def _key(x: str, y: str):
    return (F.col(x) + SPAN) * (2 * SPAN) + (F.col(y) + SPAN)


def steps(pixels: DataFrame) -> DataFrame:
    """``(p, q)``: both directions of each pair of pixels that touch, by side or corner. pixels: (i_x, i_y)."""
    at = pixels.select(F.col("i_x").cast("long").alias("i_x"), F.col("i_y").cast("long").alias("i_y")).distinct()
    shifts = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    near = at.select(_key("i_x", "i_y").alias("p"), "i_x", "i_y", F.explode(shifts).alias("s")).select("p", (F.col("i_x") + F.col("s.dx")).alias("x"), (F.col("i_y") + F.col("s.dy")).alias("y"))
    return near.select("p", _key("x", "y").alias("q")).join(at.select(_key("i_x", "i_y").alias("q")), "q", "left_semi").select("p", "q")


def _ranked(darts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps that reach a node, ``(p, q, n, ep, eq)`` with how many steps follow and the last of them, and the other steps."""
    ends = darts.join(nodes.select(F.col("node").alias("q")), "q", "left_semi").select("p", "q", F.lit(0).cast("long").alias("n"), F.col("p").alias("tp"), F.col("q").alias("tq"), F.lit(True).alias("done"))
    inner = darts.join(nodes.select(F.col("node").alias("q")), "q", "left_anti")
    follow = inner.join(darts.select(F.col("p").alias("q"), F.col("q").alias("r")), "q").where("r <> p")
    state = stored(ends.unionAll(follow.select("p", "q", F.lit(1).cast("long"), F.col("q").alias("tp"), F.col("r").alias("tq"), F.lit(False))), "steps")
    open_ = None
    while True:
        left = state.where("NOT done").count()
        if left in (0, open_):  # while a branch is open, every round closes some step of it
            break
        open_ = left
        on = state.select(F.col("p").alias("tp"), F.col("q").alias("tq"), F.col("n").alias("n2"), F.col("tp").alias("tp2"), F.col("tq").alias("tq2"), F.col("done").alias("done2"))
        moved = state.where("NOT done").join(on, ["tp", "tq"]).select("p", "q", (F.col("n") + F.col("n2")).alias("n"), F.col("tp2").alias("tp"), F.col("tq2").alias("tq"), F.col("done2").alias("done"))
        last, state = state, stored(state.where("done").unionAll(moved), "steps")
        release(last)
    found = state.where("done").select("p", "q", "n", F.col("tp").alias("ep"), F.col("tq").alias("eq"))
    return found, state.where("NOT done").select("p", "q")


def traced(pixels: DataFrame, min_pixels: int = 1) -> DataFrame:
    """``(path, k, i_x, i_y)``: the branches of a skeleton, each from its smaller end, nodes included.

    ``path`` names the first two pixels.  A pixel alone is no path; repeated
    pixels count once; a ring ends where it began.
    """
    darts = stored(steps(pixels), "pixel-steps")
    degree = darts.groupBy("p").count()
    nodes = stored(degree.where("count <> 2").select(F.col("p").alias("node")), "path-nodes")
    found, rest = _ranked(darts, nodes)
    if not rest.isEmpty():
        ring = components(rest.select(F.col("p").alias("id")).distinct(), rest.select(F.col("p").alias("a"), F.col("q").alias("b")))
        cuts = stored(ring.select(F.col("component").alias("node")).distinct(), "ring-cuts")
        found = found.unionAll(_ranked(rest, cuts)[0])
    back = found.select(F.col("p").alias("q"), F.col("q").alias("p"), F.col("n").alias("before"), F.col("eq").alias("start"), F.col("ep").alias("first"))
    whole = found.join(back, ["p", "q"]).where((F.col("n") + F.col("before") + 2 >= min_pixels) & (F.struct("start", "first") < F.struct("eq", "ep")))
    head = whole.where("before = 0").select("start", "first", F.lit(0).cast("long").alias("k"), F.col("p").alias("at"))
    rows = head.unionAll(whole.select("start", "first", F.col("before") + 1, F.col("q")))

    def x(c: str):
        return F.floor(F.col(c) / (2 * SPAN)).cast("long") - SPAN

    def y(c: str):
        return F.col(c) % (2 * SPAN) - SPAN

    name = F.concat_ws(",", x("start"), y("start"), x("first"), y("first"))
    return rows.select(name.alias("path"), "k", x("at").alias("i_x"), y("at").alias("i_y"))


def path_lengths(paths: DataFrame, pixel: float = 1.0) -> DataFrame:
    """``(path, pixels, length)``: of traced paths, a diagonal step being longer than a straight one by the square root of two."""
    before = paths.select("path", (F.col("k") + 1).alias("k"), F.col("i_x").alias("x0"), F.col("i_y").alias("y0"))
    step = F.hypot(F.col("i_x") - F.col("x0"), F.col("i_y") - F.col("y0"))
    return paths.join(before, ["path", "k"], "left").groupBy("path").agg(F.count(F.lit(1)).alias("pixels"), (F.coalesce(F.sum(step), F.lit(0.0)) * pixel).alias("length"))
