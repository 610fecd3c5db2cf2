"""Streams of localizations: event-time windows with late data, and photon binning as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, ts: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """``(start, *by, n, mean)`` by tumbling or sliding windows; rows later than ``late`` are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "mean")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """``(key, start, stop, n)``: runs of rows of a key without a pause of ``gap``."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def photon_bins(stream: DataFrame, threshold: float, key: str = "tid", order: str = "row_id", photons: str = "eco") -> DataFrame:
    """``(key, chunk, n, photons)``: a chunk as soon as its sum reaches the threshold; state is one open chunk a trace.

    Rows of a trace must come in row order across batches; within a batch they are sorted.
    """
    kind = stream.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[photons].astype(float):
            n, total = n + 1, total + v
            if total >= threshold:
                out.append((k[0], chunk, n, total))
                chunk, n, total = chunk + 1, 0, 0.0
        state.update((chunk, n, total))
        yield pd.DataFrame(out, columns=[key, "chunk", "n", "photons"])

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, chunk long, n long, photons double", "chunk long, n long, total double", "append", GroupStateTimeout.NoTimeout)
