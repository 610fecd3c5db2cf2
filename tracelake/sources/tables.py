"""Localization tables from CSV, JSON, NumPy and Parquet files, brought to canonical columns.

Canonical columns: ``row_id`` (given order), ``tid``, ``itr``, ``vld``, ``tim``
and ``x y z`` in nanometres, besides all other numeric columns.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelake.sources.formats import resolve

#: Header words by role, in order of preference, and lengths in nanometres.
ROLE_WORDS = {
    "x": ["x", "xnm", "posx", "locx", "xpos", "xposition"],
    "y": ["y", "ynm", "posy", "locy", "ypos", "yposition"],
    "z": ["z", "znm", "posz", "locz", "zpos", "zposition"],
    "tid": ["tid", "traceid", "trackid", "track", "trace", "id"],
    "tim": ["tim", "time", "t", "timestamp", "seconds"],
    "itr": ["itr", "iteration"],
    "vld": ["vld", "valid"],
    "photons": ["eco", "photons", "intensity", "counts"],
    "precision": ["precision", "uncertainty", "sigma", "sd"],
    "frame": ["frame", "frames", "slice"],
}
NANOMETRES = {"m": 1e9, "mm": 1e6, "um": 1e3, "nm": 1.0}


def header_key(name: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "", re.sub(r"[\(\[].*?[\)\]]", "", name.lower()))


def header_unit(name: str) -> str | None:
    import re

    m = re.search(r"(?:[\(\[_ ])(nm|um|µm|mm|px|ms|s|m)(?:[\)\]]|$)", name.lower())
    return m[1].replace("µ", "u") if m else None


def guess_roles(columns: list[str]) -> dict[str, str]:
    """Role to column by header words; each column serves one role."""
    keys, out = {header_key(c): c for c in reversed(columns)}, {}
    for role, names in ROLE_WORDS.items():
        for n in names:
            if n in keys and keys[n] not in out.values():
                out[role] = keys[n]
                break
    return out


def guess_unit(span: float) -> str:
    """The coarsest unit for which a field of this span is 100 nm to 1 mm wide."""
    for unit in ("m", "mm", "um"):
        if 100 <= span * NANOMETRES[unit] <= 1e6:
            return unit
    return "nm"


def column_profile(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row: count, distinct values, least, largest, whether all are whole, median step and share of rising steps in row order.

    Steps are taken within blocks of 65,536 rows of the order, so that no task sees all rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(F.floor(F.col(order) / 65536)).orderBy(order)
    v = F.col(column).cast("double")
    s = df.select(v.alias("v"), (v - F.lag(v).over(w)).alias("d"))
    return s.agg(
        F.count("v").alias("n"),
        F.count_distinct("v").alias("distinct"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.coalesce(F.bool_and(F.col("v") == F.floor("v")), F.lit(False)).alias("whole"),
        F.percentile(F.abs("d"), 0.5).alias("step"),
        F.avg((F.col("d") > 0).cast("double")).alias("rising"),
    )


class _Part(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.schema, self.path, self.rows = schema, options["path"], int(options.get("rowsPerPartition", 1_000_000))

    def partitions(self):
        n = len(np.load(self.path, mmap_mode="r"))
        return [_Part(a, min(a + self.rows, n)) for a in range(0, n, self.rows)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator:
        import pyarrow as pa

        rows = np.load(self.path, mmap_mode="r")[partition.start : partition.stop]
        columns = {"row_id": np.arange(partition.start, partition.stop)} | _columns(rows)
        yield pa.RecordBatch.from_pydict({f.name: pa.array(np.ascontiguousarray(columns[f.name])) for f in self.schema.fields})


def _columns(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of a structured array; vectors as name_x, name_y, name_z or name_0, name_1."""
    if rows.dtype.names is None:
        names = ["x", "y", "z"] if rows.ndim == 2 and rows.shape[1] <= 3 else [f"c{i}" for i in range(rows.shape[1])]
        return {n: rows[:, i] for n, i in zip(names, range(rows.shape[1]), strict=False)}
    out = {}
    for name in rows.dtype.names:
        v = rows[name]
        if v.ndim == 1:
            out[name] = v
        else:
            ends = ["_x", "_y", "_z"] if v.shape[1] == 3 else [f"_{i}" for i in range(v.shape[1])]
            out |= {name + e: v[:, i] for i, e in enumerate(ends)}
    return out


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: a structured or plain NumPy array file on a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        kinds = {"b": T.BooleanType(), "i": T.LongType(), "u": T.LongType(), "f": T.DoubleType()}
        sizes = {("i", 4): T.IntegerType(), ("i", 2): T.ShortType(), ("i", 1): T.ByteType(), ("f", 4): T.FloatType()}
        head = _columns(np.load(self.options["path"], mmap_mode="r")[:1])
        return T.StructType([T.StructField("row_id", T.LongType())] + [T.StructField(n, sizes.get((v.dtype.kind, v.dtype.itemsize), kinds[v.dtype.kind])) for n, v in head.items()])

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(schema, self.options)


def npy_bytes(pdf: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    np.save(out, pdf.to_records(index=False))
    return out.getvalue()


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A table file or a folder of them by its content, with ``dataset_id`` (the file)."""
    fmt = fmt or resolve(spark, path)[0]
    if fmt == "csv":
        head = spark.read.text(path).limit(1).collect()
        sep = max(",;\t", key=(head[0][0] if head else "").count)
        df = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    elif fmt == "json":
        first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        lines = bool(first) and first[0][0].lstrip().startswith("{") and first[0][0].rstrip().endswith("}")
        df = unwrapped(spark.read.json(path, multiLine=not lines))
    elif fmt == "npy":
        spark.dataSource.register(NpySource)
        return spark.read.format("npy").load(path).withColumn("dataset_id", F.lit(path))
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {fmt}")
    return df.withColumn("dataset_id", F.input_file_name())


def unwrapped(df: DataFrame) -> DataFrame:
    """Records out of a wrapping object, and vectors as one column a component."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if len(arrays) == 1 and not {"tid", "itr"} & set(df.columns):
        df = df.select(F.explode(arrays[0]).alias("r")).select("r.*")
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            n = 2 if f.name == "dcr" else 3
            ends = ["_0", "_1"] if n == 2 else ["_x", "_y", "_z"]
            cols += [F.get(f.name, F.lit(i)).cast("double").alias(f.name + e) for i, e in enumerate(ends)]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def is_record_schema(df: DataFrame) -> bool:
    """Localization records have an iteration or a trace and a position."""
    c = set(df.columns)
    return bool(c & {"itr", "tid"}) and bool(c & {"loc", "loc_x", "x", "x_nm", "xnm"})


def canonical(df: DataFrame, roles: Mapping[str, str] | None = None, unit: str | None = None, z_scale: float = 1.0) -> DataFrame:
    """Canonical columns from whatever names the table has.

    Positions: ``loc_*`` before ``lnc_*`` (both metres), then the guessed columns
    in the unit of their header, or the one that their span suggests.  A table
    without traces makes every row a trace; without an order column, the caller
    must give one, as row order isn't kept by files.
    """
    cols = df.columns
    for base in ("loc", "lnc"):
        if {f"{base}_x", f"{base}_y"} <= set(cols):
            found, factor = {a: f"{base}_{a}" for a in "xyz" if f"{base}_{a}" in cols}, 1e9
            break
    else:
        roles = dict(roles or guess_roles(cols))
        found = {a: roles[a] for a in "xyz" if a in roles}
        if not {"x", "y"} <= set(found):
            raise ValueError(f"no x and y among {', '.join(cols)}")
        unit = unit or ("nm" if header_key(found["x"]).endswith("nm") else header_unit(found["x"]))
        if unit is None:
            s = df.agg((F.max(found["x"]) - F.min(found["x"])).alias("s")).first()["s"]
            unit = guess_unit(float(s or 0))
        factor = NANOMETRES[unit]
    roles = dict(roles or guess_roles(cols))
    other = {r: roles[r] for r in ("tid", "tim", "itr", "vld") if r in roles}
    if "row_id" not in cols:
        raise ValueError("a row_id that gives the order of rows is needed")
    axis = {a: (F.col(found[a]).cast("double") * (factor * (z_scale if a == "z" else 1.0)) if a in found else F.lit(0.0)) for a in "xyz"}
    out = df.select(
        "row_id",
        (F.col(other["tid"]).cast("long") if "tid" in other else F.col("row_id") + 1).alias("tid"),
        (F.col(other["itr"]).cast("int") if "itr" in other else F.lit(0)).alias("itr"),
        (F.col(other["vld"]).cast("boolean") if "vld" in other else F.lit(True)).alias("vld"),
        (F.col(other["tim"]).cast("double") if "tim" in other else F.col("row_id").cast("double")).alias("tim"),
        *(axis[a].alias(a) for a in "xyz"),
        *(F.col(f"`{c}`") for c in cols if c not in {"row_id", "tid", "itr", "vld", "tim", "x", "y", "z", *found.values(), *other.values()}),
    )
    return out


def unnested(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Rows of (localization, iteration) from one row a localization whose array columns hold a value per iteration."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not arrays:
        raise ValueError("no array columns")
    rest = [c for c in df.columns if c not in arrays]
    out = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("itr", "e")).select(*rest, "itr", *(F.col(f"e.{a}").alias(a) for a in arrays))
    return out.withColumnRenamed(order, "loc_row").withColumn("row_id", F.shiftleft(F.col("loc_row").cast("long"), 20) + F.col("itr"))


def capabilities(df: DataFrame) -> dict[str, bool]:
    """What a canonical table allows; one aggregate row."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("t"), (F.max("z") - F.min("z")).alias("z"), (F.max("tim") - F.min("tim")).alias("s")).first()
    return {"localizations": s["n"] > 0, "traces": 0 < s["t"] < s["n"], "depth": bool(s["z"]), "time": bool(s["s"]), "quality": bool({"eco", "efo", "cfr"} & set(df.columns))}
