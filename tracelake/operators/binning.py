"""Photon-threshold binning: an ordered fold within each trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_photons(df: DataFrame, iterations: Sequence[int], by: Sequence[str] = ("tid", "isl")) -> DataFrame:
    """``(*by, photons)``: summed photons on the photon-bearing iterations."""
    return df.groupBy(*by).agg(F.sum(F.when(F.col("itr").isin(*iterations), F.col("eco"))).alias("photons"))


def photon_bins(df: DataFrame, threshold: float, photons: str = "eco", values: Sequence[str] = (), order: str = "row_id", weighted_time: bool = True) -> DataFrame:
    """``(tid, chunk, n, photons, tim, *values, bot, eot)``.

    Rows of a trace are added up in row order; a chunk ends as soon as its sum
    reaches the threshold, and what remains at the end is a chunk too.  Times
    and values are photon-weighted means, plain means where a chunk has no
    photons; ``bot`` and ``eot`` mark a trace's first and last chunk.  A trace
    is folded as one array of small structs.
    """
    row = F.struct(order, F.col(photons).cast("double").alias("ph"))
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(0).cast("long").alias("k"), F.array().cast("array<bigint>").alias("ks"))

    def step(s, x):
        full = s.acc + x.ph >= threshold
        return F.struct(F.when(full, 0.0).otherwise(s.acc + x.ph).alias("acc"), (s.k + F.when(full, 1).otherwise(0)).cast("long").alias("k"), F.concat(s.ks, F.array(s.k)).alias("ks"))

    traces = df.groupBy("tid").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    marked = traces.select("tid", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step, lambda s: s.ks).alias("chunk"))).alias("e")).select(
        "tid", F.col(f"e.rows.{order}").alias(order), F.col("e.chunk").alias("chunk")
    )
    rows = df.join(marked, ["tid", order])
    w = F.col(photons).cast("double")
    mean = lambda c: F.when(F.sum(w) > 0, F.sum(F.col(c) * w) / F.sum(w)).otherwise(F.avg(c))
    rows = rows.withColumn("__t0", F.min("tim").over(Window.partitionBy("tid", "chunk")))  # sums of seconds since then keep the digits that sums of epoch seconds lose
    since = F.col("tim") - F.col("__t0")
    time = F.min("__t0") + F.when(F.sum(w) > 0, F.sum(since * w) / F.sum(w)).otherwise(F.avg(since)) if weighted_time else F.min_by("tim", order)
    chunks = rows.groupBy("tid", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("photons"), time.alias("tim"), *(mean(v).alias(v) for v in values))
    last = chunks.groupBy("tid").agg(F.max("chunk").alias("__last"))
    return chunks.join(last, "tid").withColumn("bot", F.col("chunk") == 0).withColumn("eot", F.col("chunk") == F.col("__last")).drop("__last")
