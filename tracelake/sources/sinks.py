"""Sinks: tables in several formats, with a recipe beside them that replays filters and calibration."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.filters import Spec, apply_specs
from tracelake.operators.histogram import pyramid, raster

SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "space": " "}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = "comma", names: Mapping[str, str] | None = None, mode: str = "error") -> None:
    """A distributed write; Spark's commit makes it appear as a whole. ``names`` selects and renames columns."""
    if names:
        df = df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))
    if fmt == "csv":
        df.write.mode(mode).csv(path, header=True, sep=SEPARATORS.get(sep, sep))
    elif fmt in ("json", "parquet", "orc"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"no writer for {fmt}")


def snapshot(df: DataFrame, specs: Sequence[Spec] = (), flag: bool = False, z_scale: float = 1.0) -> DataFrame:
    """Calibrated rows that pass the filters, or all rows with ``ftr``."""
    from tracelake.operators.filters import with_masks

    df = df.withColumn("z", F.col("z") * z_scale) if "z" in df.columns and z_scale != 1.0 else df
    if not flag:
        return apply_specs(df, specs)
    masked = with_masks(df, specs)
    names = [f"ok{i}" for i in range(len(specs))]
    passed = F.lit(True)
    for n in names:
        passed = passed & F.col(n)
    return masked.withColumn("ftr", passed).drop(*names)


def write_recipe(spark: SparkSession, path: str, specs: Sequence[Spec], **more) -> None:
    """A one-line JSON text beside a table."""
    text = json.dumps({"kind": "recipe", "filters": [asdict(s) for s in specs]} | more, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_recipe(spark: SparkSession, path: str) -> dict:
    payload = json.loads("".join(r[0] for r in spark.read.text(path).collect()))
    if payload.get("kind") != "recipe":
        raise ValueError(f"{path} holds no recipe")
    return payload | {"filters": [Spec(**s) for s in payload["filters"]]}


def replay(df: DataFrame, recipe: Mapping) -> DataFrame:
    """The recipe on a table; filters on columns that it doesn't have are left out."""
    specs = [s for s in recipe["filters"] if s.attribute in df.columns]
    return snapshot(df, specs, z_scale=recipe.get("z_scale", 1.0))


def write_pyramid(df: DataFrame, path: str, size: float, levels: int) -> None:
    pyramid(raster(df, size), levels).write.partitionBy("level").parquet(path)


def frames_by_time(df: DataFrame, pixel: float) -> DataFrame:
    """Export rows for a plain localization list: pixel coordinates from 0, and a frame for each distinct time.

    Times are ranked from per-time counts over ranges, so that no task orders all rows.
    """
    from pyspark.sql import Window

    times = df.select("tim").distinct()
    bucket = times.agg(F.min("tim").alias("a"), F.max("tim").alias("b")).first()
    width = max((bucket["b"] - bucket["a"]) / 1024, 1e-12) if bucket["a"] is not None else 1.0
    dealt = times.withColumn("k", F.floor((F.col("tim") - F.lit(bucket["a"])) / width).cast("long"))
    sizes = dealt.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 1025 rows
    ranked = dealt.join(F.broadcast(before.select("k", "before")), "k").withColumn("frame", F.col("before") + F.row_number().over(Window.partitionBy("k").orderBy("tim")) - 1)
    low = df.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    out = df.join(ranked.select("tim", "frame"), "tim").crossJoin(F.broadcast(low))
    return out.select("frame", ((F.col("x") - F.col("x0")) / pixel).alias("x"), ((F.col("y") - F.col("y0")) / pixel).alias("y"), *(c for c in df.columns if c not in ("x", "y")))


def append_journal(spark: SparkSession, path: str, kind: str, details: Mapping) -> None:
    """One event more in an append-only journal table."""
    row = [(kind, json.dumps(dict(details), sort_keys=True, default=str))]
    spark.createDataFrame(row, "kind string, details string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
