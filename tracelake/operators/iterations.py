"""Filters and columns that belong to an iteration of their own, and matrices with a column for each iteration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number, trace_aggregate_over
from tracelake.operators.filters import Spec, in_range
from tracelake.operators.selection import with_islands
from tracelake.storage import stored

#: What an iteration spec may name besides a number.
SELECTORS = ("browse", "all", "last", "effective", "sum", "average")
#: Attributes measured at an iteration of their own, and the metadata key of its number, from 1.
MEASURED = {"cfr": "cfr_iteration", "efc": "efc_iteration"}


@dataclass(frozen=True)
class IterationSpec:
    """A range on the value at ``iteration``: a number from 0 or one of SELECTORS; None resolves.

    ``mode`` is ``loc`` or a trace aggregate of those values, the bounds may be open.
    """

    attribute: str
    lo: float | None = None
    hi: float | None = None
    iteration: int | str | None = None
    mode: str = "loc"
    lo_inc: bool = True
    hi_inc: bool = True


def measured_iterations(metadata: Mapping[str, object], iterations: int) -> dict[str, int]:
    """Attributes with an iteration of their own, counted from 0, by a recording's metadata; none where it is the last one anyway or makes no sense."""
    out = {}
    for attribute, key in MEASURED.items():
        try:
            k = int(metadata[key]) - 1
        except (KeyError, TypeError, ValueError):
            continue
        if 0 <= k < iterations - 1:
            out[attribute] = k
    return out


def resolved_iteration(spec: IterationSpec, measured: Mapping[str, int] | None = None) -> int | str:
    """None is ``effective`` for a measured attribute, else ``last``; so is text that names nothing."""
    own = spec.iteration
    if own is None:
        return "effective" if spec.attribute in (measured or {}) else "last"
    if isinstance(own, int) and not isinstance(own, bool):
        return own
    text = str(own).strip().lower()
    return text if text in SELECTORS else int(text) if text.isdecimal() else "last"


def localization_value(attribute: str, iteration: int | str, measured: Mapping[str, int] | None = None, order: str = "row_id", top: str = "top") -> Column:
    """A column over rows with ``isl`` and the last iteration ``top``: the value that the iteration names, on all rows of its localization; null without any.

    ``all`` and ``browse`` take each row's own value.  ``sum`` and ``average``
    pool the valid finite ones of localizations that have a valid last iteration,
    in the order of rows, since the last digits of a sum depend on its order.
    """
    own, v = Window.partitionBy("tid", "isl").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), number(attribute)
    if iteration in ("all", "browse"):
        return v
    ends = F.col("vld") & (F.col("itr") == F.col(top))
    if iteration in ("sum", "average"):
        usable = F.when(F.col("vld") & (F.abs(v) < float("inf")), v)
        pooled = (F.sum if iteration == "sum" else F.avg)(usable).over(own)
        return F.when(F.max(ends).over(own), pooled)
    if iteration == "effective" and attribute in (measured or {}):
        at = F.col("vld") & (F.col("itr") == measured[attribute])
    else:
        at = ends if iteration in ("last", "effective") else F.col("itr") == iteration
    return F.max_by(v, F.when(at, F.col(order))).over(own)


def apply_iteration_specs(df: DataFrame, specs: Sequence[IterationSpec], order: str = "row_id", measured: Mapping[str, int] | None = None) -> tuple[DataFrame, list[str]]:
    """The rows, of every iteration, that pass all specs; and the attributes that could not be evaluated, which don't filter.

    The last iteration is one broadcast row, and all values share one pass over the localizations.
    """
    known = [s for s in specs if s.attribute in df.columns]
    top = df.where("vld").agg(F.max("itr").alias("__top"))
    flagged = with_islands(df, order).crossJoin(F.broadcast(top))
    values = [localization_value(s.attribute, resolved_iteration(s, measured), measured, order, "__top").alias(f"__v{i}") for i, s in enumerate(known)]
    flagged = flagged.select("*", *values)
    by_trace = [trace_aggregate_over(s.mode, f"__v{i}", order, Window.partitionBy("tid")).alias(f"__t{i}") for i, s in enumerate(known) if s.mode != "loc"]
    flagged = flagged.select("*", *by_trace)
    for i, s in enumerate(known):
        v = F.col(f"__v{i}" if s.mode == "loc" else f"__t{i}")
        flagged = flagged.where(in_range(v, Spec(s.attribute, s.mode, s.lo, s.hi, s.lo_inc, s.hi_inc)))
    return flagged.drop(*(c for c in flagged.columns if c.startswith("__"))), sorted({s.attribute for s in specs} - set(df.columns))


def matrix_columns(df: DataFrame, matrices: Sequence[str], dominant: Sequence[str] = (), valid: str | None = None) -> DataFrame:
    """Each matrix (an array with a value for each iteration) as one column: the last value, or for ``dominant`` ones the iteration with the largest summed magnitude.

    Values that are NaN add nothing to a sum; rows that aren't ``valid`` go.
    """
    out = df if valid is None else df.where(F.col(valid))
    for c in matrices:
        if c in dominant:
            size = F.when(~F.isnan("v"), F.abs("v"))
            sums = out.select(F.posexplode(c).alias("k", "v")).groupBy("k").agg(F.coalesce(F.sum(size), F.lit(0)).alias("s"))
            best = sums.agg(F.min_by("k", F.struct(-F.col("s"), "k")).alias(f"__best_{c}"))  # one row
            out = out.crossJoin(F.broadcast(best)).withColumn(c, F.get(c, F.coalesce(F.col(f"__best_{c}"), F.lit(0)))).drop(f"__best_{c}")
        else:
            out = out.withColumn(c, F.when(F.size(c) > 0, F.element_at(c, -1)))
    return out


def with_position(df: DataFrame, order: Sequence[str] = ("tid", "row_id"), ranges: int | None = None) -> DataFrame:
    """``idx``: each row's place, from 1, in the whole unfiltered table; it stays when rows are filtered.

    Rows are dealt out by ranges of the order, counted by range, and numbered within; no task sees more than a range.
    Rows of one ``order`` share a range, so it should tell rows apart.
    """
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").count()
    before = counts.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))  # a row a range
    numbered = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return numbered.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__before") + F.col("__k")).alias("idx"))


def with_trace_position(df: DataFrame, key: str = "tid", order: str = "row_id") -> DataFrame:
    """``idx``: each row's place, from 1, within its group."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(order)))
