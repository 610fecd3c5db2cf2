"""Connected components and density clustering, as Spark jobs on link tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import tiles
from tracelake.operators.spatial import local_density
from tracelake.storage import release, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links: a > b."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)`` but the roots; a root is its component's smallest node.

    Alternating large-star and small-star steps; each is a minimum by node,
    pre-aggregated in the map tasks, and a join on that node, so no node's
    neighbours are ever gathered in one row.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(ordered, "links"), None
    while True:  # every round but the last moves some node to a smaller one
        last, edges = edges, stored(_small_star(_large_star(edges)), "stars")
        release(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(nodes: DataFrame, links: DataFrame, min_size: int = 1) -> DataFrame:
    """``(id, component)`` of the nodes ``(id)``, singletons included; smaller components go."""
    found = nodes.join(roots(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    if min_size <= 1:
        return found
    big = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("component")
    return found.join(big, "component", "left_semi").select("id", "component")


def _forest(points: DataFrame, grid: tiles.Grid) -> DataFrame:
    """Links ``(a, b)`` that join the same points as all pairs within the grid's radius: a forest of each tile, never all pairs."""
    axes, radius, kind = grid.axes, grid.radius, points.schema["id"].dataType.simpleString()

    def links(own: pa.Table, near: pa.Table) -> pa.Table:
        ids = np.concatenate([own["id"].to_numpy(), near["id"].to_numpy()])
        label, n = np.arange(len(ids)), own.num_rows
        for i, j, d2, _same in tiles.meetings(tiles.places(own, axes), tiles.places(near, axes), grid):
            k, m = np.nonzero(d2 <= radius * radius)
            label = tiles.merged_labels(label, i[k], n + j[m])
        linked = np.flatnonzero(ids != ids[label])
        return pa.table({"a": ids[linked], "b": ids[label[linked]]})

    return tiles.by_tile(points, points, grid, links, f"a {kind}, b {kind}")


def near_components(points: DataFrame, radius: float, axes=("x", "y")) -> DataFrame:
    """``(id, component)`` of the graph that links points ``(id, *axes)`` within the radius; a point without a place is alone."""
    p = tiles.finite(points.select("id", *axes), axes)
    return components(points.select("id"), _forest(p, tiles.grid_of(p, radius, axes)))


def dbscan(points: DataFrame, radius: float, min_points: int, axes=("x", "y")) -> DataFrame:
    """``(id, cluster)``: the smallest core id of a point's cluster, -1 for noise.

    A point with ``min_points`` within the radius (itself included) is a core.
    Cores within the radius of each other share a cluster; a border point takes
    the smallest cluster among its cores.
    """
    axes = tuple(axes)
    every = points.select("id", *axes)
    p = stored(tiles.finite(every, axes), "points")
    grid = tiles.grid_of(p, radius, axes)
    kind = p.schema["id"].dataType.simpleString()
    core = stored(local_density(p, radius, axes).where(F.col("den") >= min_points).select("id"), "cores")
    cores = stored(p.join(core, "id", "left_semi"), "core-points")
    named = stored(components(core, _forest(cores, grid)), "core-clusters")
    border = p.join(core, "id", "left_anti").withColumn("component", F.lit(0).cast(kind))
    clusters = cores.join(named, "id").select("id", *axes, "component")

    def nearest(own: pa.Table, near: pa.Table) -> pa.Table:
        ids, cluster = own["id"].to_numpy(), near["component"].to_numpy()
        most = np.iinfo(np.int64).max
        best = np.full(len(ids), most)
        for i, j, d2, _same in tiles.meetings(tiles.places(own, axes), tiles.places(near, axes), grid):
            best[i] = np.minimum(best[i], np.where(d2 <= radius * radius, cluster[j][None], most).min(1))
        met = best < most
        return pa.table({"id": ids[met], "near": best[met]})

    reach = tiles.by_tile(border, clusters, grid, nearest, f"id {kind}, near long").groupBy("id").agg(F.min("near").alias("near"))
    return (
        every.select("id").join(named, "id", "left").join(reach, "id", "left").select("id", F.coalesce("component", "near", F.lit(-1).cast("long")).alias("cluster"))
    )
