"""The closed registry of per-trace aggregates, and number helpers.

NaN is missing data: it is nulled before an aggregate or a comparison, because
Spark orders NaN above all numbers and lets it through ``avg``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(v: Column | str) -> Column:
    """The value, null where it is NaN."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(~F.isnan(v), v)


#: value column and row order to an aggregate; first and last keep NaN as it is.
TRACE_AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "mean": lambda v, order: F.avg(number(v)),
    "median": lambda v, order: F.percentile(number(v), 0.5),
    "min": lambda v, order: F.min(number(v)),
    "max": lambda v, order: F.max(number(v)),
    "first": lambda v, order: F.min_by(v, order),
    "last": lambda v, order: F.max_by(v, order),
    "stdev": lambda v, order: F.stddev_pop(number(v)),
    "range": lambda v, order: F.max(number(v)) - F.min(number(v)),
}


def trace_aggregate(mode: str, value: str, order: str = "row_id") -> Column:
    if mode not in TRACE_AGGREGATES:
        raise ValueError(f"no trace aggregate {mode!r}; there are {', '.join(TRACE_AGGREGATES)}")
    return TRACE_AGGREGATES[mode](F.col(value), F.col(order))


def trace_aggregate_over(mode: str, value: str, order: str, window) -> Column:
    """The aggregate on every row of its trace."""
    if mode == "range":
        return F.max(number(value)).over(window) - F.min(number(value)).over(window)
    return trace_aggregate(mode, value, order).over(window)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over finite values with positive finite weights."""
    good = number(value).isNotNull() & (number(weight) > 0)
    return F.sum(F.when(good, value * weight)) / F.sum(F.when(good, weight))


def percentiles(value: Column, *shares: float) -> Column:
    return F.percentile(number(value), F.array(*map(F.lit, shares)))
