"""A small facade over named tables: what a script needs to read columns, filter and log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.filters import Spec, apply_specs
from tracelake.operators.selection import derived, select_iteration
from tracelake.sources import sinks, tables


class Engine:
    """Registered tables are lazy DataFrames, and temporary views of the session, so Spark SQL reads them too."""

    def __init__(self, spark: SparkSession, journal: str | None = None):
        self.spark, self.journal = spark, journal
        self.tables: dict[str, DataFrame] = {}
        self.filters: dict[str, list[Spec]] = {}

    def open(self, name: str, path: str, fmt: str | None = None, **canonical) -> DataFrame:
        return self.add(name, tables.canonical(tables.read_any(self.spark, path, fmt), **canonical))

    def add(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.tables:
            raise ValueError(f"there is a table {name} already")
        self.tables[name], self.filters[name] = df, []
        df.createOrReplaceTempView(name)
        self.log("open", {"table": name, "columns": df.columns})
        return df

    def set_filters(self, name: str, specs: Sequence[Spec]) -> None:
        self.filters[name] = list(specs)
        self.log("filter", {"table": name, "filters": [str(s) for s in specs]})

    def view(self, name: str, itr: str | int = "last", filtered: bool = True) -> DataFrame:
        df = derived(select_iteration(self.tables[name], itr), ["x", "y", "z"])
        return apply_specs(df, self.filters[name]) if filtered and self.filters[name] else df

    def column(self, name: str, column: str, itr: str | int = "last", filtered: bool = True) -> DataFrame:
        return self.view(name, itr, filtered).select("row_id", column)

    def positions(self, name: str, unit: str = "nm", **view) -> DataFrame:
        scale = 1 / tables.NANOMETRES[unit]
        return self.view(name, **view).select("row_id", *((F.col(a) * scale).alias(a) for a in "xyz"))

    def reset(self, name: str) -> None:
        self.filters[name] = []
        self.log("reset", {"table": name})

    def save(self, name: str, path: str, fmt: str = "parquet") -> None:
        """The filtered rows, and the recipe that made them beside the table."""
        sinks.write_table(self.view(name), path, fmt)
        sinks.write_recipe(self.spark, f"{path}.recipe", self.filters[name])

    def log(self, kind: str, details: Mapping) -> None:
        if self.journal:
            sinks.append_journal(self.spark, self.journal, kind, details)
