"""Re-evaluable range filters, windows of values and times, and region crops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.aggregates import number, trace_aggregate_over


@dataclass(frozen=True)
class Spec:
    """A range on a row's value (mode ``loc``) or on an aggregate of its trace."""

    attribute: str
    mode: str = "loc"
    lo: float | None = None
    hi: float | None = None
    lo_inc: bool = True
    hi_inc: bool = True


#: A sum's last digits depend on its order, so a mean or a deviation is on a bound within this share of it.
ON_BOUND = 1e-12


def in_range(v: Column, spec: Spec) -> Column:
    """NaN fails; null gives null, which fails in ``where`` and leaves the bounds to be pushed to the scan."""
    ok = v.isNotNull() & ~F.isnan(v)
    share = ON_BOUND if spec.mode in ("mean", "stdev") else 0.0
    if spec.lo is not None:
        lo, room = float(spec.lo), abs(spec.lo) * share
        ok = ok & (v >= lo - room if spec.lo_inc else v > lo + room)
    if spec.hi is not None:
        hi, room = float(spec.hi), abs(spec.hi) * share
        ok = ok & (v <= hi + room if spec.hi_inc else v < hi - room)
    return ok


def with_masks(df: DataFrame, specs: Sequence[Spec], order: str = "row_id") -> DataFrame:
    """``ok0, ok1, ...``: each spec on the unfiltered rows; trace specs share one pass over the trace."""
    missing = [s.attribute for s in specs if s.attribute not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    trace = sorted({(s.attribute, s.mode) for s in specs if s.mode != "loc"})
    w = Window.partitionBy("tid")
    for a, m in trace:
        df = df.withColumn(f"__{m}_{a}", trace_aggregate_over(m, a, order, w))
    for i, s in enumerate(specs):
        v = F.col(s.attribute if s.mode == "loc" else f"__{s.mode}_{s.attribute}").cast("double")
        df = df.withColumn(f"ok{i}", F.coalesce(in_range(v, s), F.lit(False)))
    return df.drop(*(f"__{m}_{a}" for a, m in trace))


def apply_specs(df: DataFrame, specs: Sequence[Spec], order: str = "row_id") -> DataFrame:
    """Rows that pass all specs. Row specs alone stay plain predicates, which reach the scan."""
    if all(s.mode == "loc" for s in specs):
        return reduce(lambda d, s: d.where(in_range(F.col(s.attribute), s)), specs, df)
    masked = with_masks(df, specs, order)
    names = [f"ok{i}" for i in range(len(specs))]
    return masked.where(reduce(lambda a, b: a & b, map(F.col, names))).drop(*names)


def value_range(v: Column, a: float, b: float) -> Column:
    lo, hi = min(a, b), max(a, b)
    return F.coalesce(number(v).between(lo, hi), F.lit(False))


def any_of(masks: Sequence[Column]) -> Column:
    """Union of regions; no region selects nothing."""
    return reduce(lambda a, b: a | b, masks, F.lit(False))


def all_of(masks: Sequence[Column]) -> Column:
    """Intersection of extrusions; none selects nothing."""
    return reduce(lambda a, b: a & b, masks) if masks else F.lit(False)


def crop(df: DataFrame, inside, x: str, y: str, trace_complete: bool) -> DataFrame:
    """Rows inside a region, or whole traces whose centroid is inside. ``inside`` maps two columns to a mask."""
    if not trace_complete:
        return df.where(inside(F.col(x), F.col(y)))
    w = Window.partitionBy("tid")
    centred = df.withColumn("__cx", F.avg(x).over(w)).withColumn("__cy", F.avg(y).over(w))
    return centred.where(inside(F.col("__cx"), F.col("__cy"))).drop("__cx", "__cy")


def value_window(v: Column, windows: Sequence[tuple[float, float]]) -> Column:
    """Index of the first inclusive window that holds the value, -1 outside."""
    out = F.lit(-1)
    for k, (lo, hi) in reversed(list(enumerate(windows))):
        out = F.when(F.coalesce(number(v).between(lo, hi), F.lit(False)), k).otherwise(out)
    return out


@dataclass(frozen=True)
class TimeWindow:
    name: str
    start: float
    end: float


def checked_windows(windows: Sequence[TimeWindow]) -> list[TimeWindow]:
    """Sorted by start; names must differ and windows must not overlap."""
    out = sorted(windows, key=lambda w: w.start)
    if len({w.name for w in out}) < len(out):
        raise ValueError("names of time windows must differ")
    for w in out:
        if not w.start < w.end:
            raise ValueError(f"window {w.name} has no length")
    for a, b in zip(out, out[1:], strict=False):
        if b.start < a.end:
            raise ValueError(f"windows {a.name} and {b.name} overlap")
    return out


def time_channel(t: Column, windows: Sequence[TimeWindow]) -> Column:
    """A window's name; a shared boundary belongs to the later window, an end before a gap to its own."""
    windows = checked_windows(windows)
    out = F.lit(None).cast("string")
    for k in range(len(windows) - 1, -1, -1):
        w = windows[k]
        adjacent = k + 1 < len(windows) and windows[k + 1].start == w.end
        inside = (t >= w.start) & (t < w.end if adjacent else t <= w.end)
        out = F.when(inside, w.name).otherwise(out)
    return out


def even_windows(lo: float, hi: float, n: int) -> list[tuple[float, float]]:
    step = (hi - lo) / n
    return [(lo + i * step, lo + (i + 1) * step) for i in range(n)]


def windows_from_boundaries(lo: float, hi: float, cuts: Sequence[float]) -> list[tuple[float, float]]:
    """Adjacent windows from cut points, clipped to [lo, hi] and kept in order."""
    edges = [lo]
    for c in cuts:
        edges.append(min(max(c, edges[-1]), hi))
    edges.append(hi)
    return list(zip(edges, edges[1:], strict=False))


def stride_sample(df: DataFrame, step: int, order: str = "row_id") -> DataFrame:
    """Every ``step``-th row of each trace in row order: the same rows each time."""
    w = Window.partitionBy("tid").orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") - 1) % step == 0).drop("__n")
