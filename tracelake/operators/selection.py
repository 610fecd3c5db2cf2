"""Iteration selection, localization ids, pooling and derived columns.

The working columns are ``tid``, ``row_id`` (row order), ``itr`` and ``vld``.
All windows are partitioned by trace, so nothing is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number


def trace_window(order: str | list[str] = "row_id") -> Window:
    return Window.partitionBy("tid").orderBy(*([order] if isinstance(order, str) else order))


def last_valid(df: DataFrame, valid_only: bool = True) -> DataFrame:
    """Rows of the largest iteration among the base rows; a localization that never reaches it has none."""
    base = df.where("vld") if valid_only else df
    top = base.agg(F.max("itr").alias("__top"))  # one row
    return base.join(F.broadcast(top), F.col("itr") == F.col("__top")).drop("__top")


def select_iteration(df: DataFrame, itr: str | int, valid_only: bool = True) -> DataFrame:
    """Selector ``last``, ``all`` or a 0-based iteration."""
    if itr == "last":
        return last_valid(df, valid_only)
    base = df.where("vld") if valid_only else df
    return base if itr == "all" else base.where(F.col("itr") == int(itr))


def with_islands(df: DataFrame, order: str | list[str] = "row_id") -> DataFrame:
    """``isl``: a new localization starts where the iteration doesn't grow within its trace."""
    w = trace_window(order)
    new = F.when(F.col("itr") > F.lag("itr").over(w), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("isl", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def pooled(df: DataFrame, value: str, how: str) -> DataFrame:
    """``(tid, isl, pooled)``: sum or average of a localization's finite values, null without any. df has ``isl``."""
    v = number(value)
    agg = {"sum": F.sum(v), "average": F.avg(v)}[how]
    return df.groupBy("tid", "isl").agg(agg.alias("pooled"))


def broadcast_last(df: DataFrame, value: str, order: str | list[str] = "row_id") -> DataFrame:
    """``bc``: the value at a localization's last-valid row on all of its rows."""
    flagged = with_islands(df, order)
    top = flagged.where("vld").agg(F.max("itr").alias("__top"))
    flagged = flagged.crossJoin(F.broadcast(top))  # one row
    is_last = F.col("vld") & (F.col("itr") == F.col("__top"))
    return flagged.withColumn("bc", F.max(F.when(is_last, F.col(value))).over(Window.partitionBy("tid", "isl"))).drop("__top")


def value_at_iteration(df: DataFrame, value: str, itr: int, order: str = "row_id") -> DataFrame:
    """``at_itr``: the localization's value at an iteration, invalid rows included; the last row counts."""
    flagged = with_islands(df, order)
    key = F.when(F.col("itr") == itr, F.col(order))
    return flagged.withColumn("at_itr", F.max_by(F.col(value), key).over(Window.partitionBy("tid", "isl")))


def iteration_signal(df: DataFrame, value: str) -> DataFrame:
    """``(itr, signal, present)`` over valid rows: summed magnitude, and whether any value is finite and not zero."""
    v = number(value)
    return df.where("vld").groupBy("itr").agg(F.sum(F.abs(v)).alias("signal"), F.coalesce(F.bool_or(v != 0), F.lit(False)).alias("present"))


def effective_iteration(df: DataFrame, value: str) -> DataFrame:
    """The iteration of largest summed magnitude, the lowest of equals."""
    return iteration_signal(df, value).orderBy(F.desc("signal"), "itr").limit(1).select("itr")


def derived(df: DataFrame, coords: list[str], order: str = "row_id") -> DataFrame:
    """Per row ``dt dst spd len tim_trace`` and per trace ``siz dur``; differences are 0 at a trace's first row."""
    w, whole = trace_window(order), Window.partitionBy("tid")
    step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    df = df.withColumn("dt", step("tim")).withColumn("dst", F.sqrt(sum((F.pow(step(c), 2) for c in coords[1:]), F.pow(step(coords[0]), 2))))
    return (
        df.withColumn("spd", F.when(F.col("dt") > 0, F.col("dst") / F.col("dt")).otherwise(0.0))
        .withColumn("siz", F.count(F.lit(1)).over(whole))
        .withColumn("dur", F.max("tim").over(whole) - F.min("tim").over(whole))
        .withColumn("len", F.sum("dst").over(whole))
        .withColumn("tim_trace", F.col("tim") - F.min("tim").over(whole))
    )


def dense_tids(df: DataFrame, channel: str = "channel") -> DataFrame:
    """``(channel, tid, new_tid)``: dense trace numbers over channels, without gaps.

    Ranks within a channel plus the number of traces in earlier channels; the
    channel totals are one row a channel.
    """
    ids = df.select(channel, "tid").distinct()
    totals = ids.groupBy(channel).agg(F.count(F.lit(1)).alias("n"))
    before = totals.alias("a").join(F.broadcast(totals.alias("b")), F.col(f"b.{channel}") < F.col(f"a.{channel}"), "left").groupBy(F.col(f"a.{channel}").alias(channel)).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    rank = F.dense_rank().over(Window.partitionBy(channel).orderBy("tid"))
    return ids.withColumn("__rank", rank).join(F.broadcast(before), channel).select(channel, "tid", (F.col("__rank") - 1 + F.col("before")).cast("long").alias("new_tid"))


def final_flags(df: DataFrame, order: str = "row_id") -> DataFrame:
    """``fnl``: the last row of each localization group."""
    flagged = with_islands(df, order)
    w = Window.partitionBy("tid", "isl").orderBy(F.desc(order))
    return flagged.withColumn("fnl", F.row_number().over(w) == 1)


def event_ids(df: DataFrame, flag: Column, order: str = "row_id") -> DataFrame:
    """``event``: how many flagged rows come before a row in its trace."""
    w = trace_window(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("event", F.coalesce(F.sum(flag.cast("long")).over(w), F.lit(0).cast("long")))
