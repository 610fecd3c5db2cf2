"""Sets of clouds and beads as tables, column catalogues, and what an export would take."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def particle_set(points: DataFrame, key: str = "tid", axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """``(particle, n, cloud)``: each group's points about their mean, in order of id. A particle is one structure, so its cloud is one row."""
    mean = points.groupBy(F.col(key).alias("particle")).agg(*(F.avg(a).alias(f"m_{a}") for a in axes))
    at = points.join(mean, points[key] == mean["particle"]).select("particle", "id", *((F.col(a) - F.col(f"m_{a}")).alias(a) for a in axes))
    return at.groupBy("particle").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", *axes))).alias("cloud"))


def write_particles(particles: DataFrame, path: str, mode: str = "error") -> None:
    particles.write.mode(mode).parquet(path)


def read_particles(spark: SparkSession, path: str, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """``(particle, id, *axes)``, a row a point."""
    return spark.read.parquet(path).select("particle", F.explode("cloud").alias("p")).select("particle", "p.id", *(f"p.{a}" for a in axes))


def bead_table(parts: Mapping[int, DataFrame]) -> DataFrame:
    """Tables of single beads as one, with the bead's number in ``gri``; columns that some lack are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("gri", F.lit(g)) for g, df in sorted(parts.items())])


def fields(df: DataFrame) -> list[tuple[str, str]]:
    """Every field of a nested schema by its path, with its type."""
    out = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]")
        else:
            out.append((path, kind.simpleString()))

    walk(df.schema, "")
    return out


def vectors(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Scalar columns put together as vectors, ``{"loc": ["x", "y", "z"]}``; a vector with any null part is null."""
    gone = {c for parts in groups.values() for c in parts}
    made = [F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts]), F.array(*parts)).alias(name) for name, parts in groups.items()]
    return df.select(*(c for c in df.columns if c not in gone), *made)


def flattened(df: DataFrame, vector: str, suffixes: Sequence[str]) -> DataFrame:
    """A vector column as scalar columns ``vector_suffix``; a vector of another length is an error."""
    size = len(suffixes)
    checked = F.when(F.col(vector).isNull() | (F.size(vector) == size), F.col(vector)).otherwise(F.raise_error(F.lit(f"{vector} must have {size} parts")).cast(df.schema[vector].dataType))
    return df.withColumn(vector, checked).select(*(c for c in df.columns if c != vector), *(F.get(vector, F.lit(i)).alias(f"{vector}_{s}") for i, s in enumerate(suffixes)))


def flat_table(df: DataFrame) -> DataFrame:
    """A processed table read again: coordinates are final, so the z factor is 1; a saved filter flag ``ftr`` is kept, or true for all."""
    if not {"x", "y"} <= set(df.columns):
        raise ValueError("a processed table has x and y")
    ftr = F.coalesce(F.col("ftr").cast("boolean"), F.lit(True)) if "ftr" in df.columns else F.lit(True)
    return df.withColumn("z", F.col("z") if "z" in df.columns else F.lit(0.0)).withColumn("z_factor", F.lit(1.0)).withColumn("ftr", ftr)


def plot_columns(df: DataFrame, prefer: Sequence[str] = ("efo", "cfr", "eco", "dcr", "tim"), hidden: Sequence[str] = ("row_id",)) -> list[str]:
    """The numeric scalar columns, preferred ones first, others by name."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in hidden]
    return [c for c in prefer if c in numeric] + sorted(c for c in numeric if c not in prefer)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, or an error that names what an analysis lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"this needs {', '.join(missing)}")
    return df


def bounds_of(df: DataFrame, column: str) -> DataFrame:
    """``(lo, hi)``: the finite range of a column, as the default of a filter on it."""
    v = F.col(column).cast("double")
    ok = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"))


def time_unit(step: Column, whole: Column) -> Column:
    """s for a median step below 0.1, ms up to 50, null for whole numbers, larger steps and those of zero or less."""
    return F.when(whole | step.isNull() | F.isnan(step) | (step <= 0), F.lit(None)).when(step < 0.1, "s").when(step <= 50, "ms")


def export_estimate(df: DataFrame, rate: float = 180 * 2**20) -> DataFrame:
    """``(rows, bytes, seconds)`` of a table's export: one pass over the rows, widths by type and by the lengths of strings."""
    fixed = sum(8 if isinstance(f.dataType, (T.DoubleType, T.LongType, T.TimestampType)) else 1 if isinstance(f.dataType, T.BooleanType) else 4 for f in df.schema if not isinstance(f.dataType, T.StringType))
    text = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)), F.lit(0))
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text + fixed), F.lit(0)).cast("long").alias("bytes"))
    return total.select("rows", "bytes", (F.col("bytes") / rate).alias("seconds"))


def trace_payload(df: DataFrame, traces: Sequence[int], columns: Sequence[str], order: str = "row_id") -> DataFrame:
    """``(tid, n, rows)`` of some chosen traces: their raw columns in order. The traces are picked by hand; their filter reaches the scan."""
    chosen = df.where(F.col("tid").isin(list(traces)))
    return chosen.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
