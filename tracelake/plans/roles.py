"""Role views: relational tables bound to the columns of a localization table.

Columns: ``tid`` trace, ``row_id`` row order, ``itr`` iteration, ``tim`` seconds,
``vld`` valid, and value columns.  Each view is a list of select expressions
that reads the same in Spark SQL and in ANSI SQL, so that a view has one
definition; where the dialects differ, ``{micros}`` and the like stand in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {"micros": "unix_micros(CAST(ts AS timestamp))", "days": "datediff(CAST({0} AS date), DATE'1970-01-01')", "at": "embedding[{0}]", "first": 0},
    "ansi": {"micros": "epoch_us(ts)", "days": "date_diff('day', DATE '1970-01-01', CAST({0} AS date))", "at": "embedding[{0}]", "first": 1},
}

VIEWS: dict[str, tuple[str, list[str]]] = {
    "trace_stream": (
        "events",
        [
            "CAST(user_id AS bigint) AS tid",
            "CAST(event_id AS bigint) AS row_id",
            "CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS int) AS itr",
            "{micros} / 1000000.0D0 AS tim",
            "event_type <> 'error' AS vld",
            "CAST(value AS double) AS eco",
        ],
    ),
    "ladder": (
        "conversations",
        ["CAST(conv_id AS bigint) AS tid", "CAST(turn AS bigint) AS row_id", "CAST(turn AS int) AS itr", "CAST(turn AS double) AS tim", "length(text) > 0 AS vld", "CAST(length(text) AS double) AS eco"],
    ),
    "iter_table": (
        "lineitem",
        [
            "CAST(l_orderkey AS bigint) AS tid",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            "l_extendedprice",
            "CAST(l_linenumber - 1 AS int) AS itr",
            "CAST({days:l_shipdate} AS double) AS tim",
            "l_returnflag <> 'R' AS vld",
            "CAST(l_quantity AS double) AS eco",
            "CAST(l_extendedprice AS double) AS efo",
            "CAST(l_discount * 10 AS double) AS dcr",
            "CAST(l_tax AS double) AS fbg",
        ],
    ),
    "points": (
        "orders",
        [
            "CAST(o_orderkey AS bigint) AS id",
            "CAST(o_custkey AS bigint) AS tid",
            "CAST(o_totalprice / 100 AS double) AS x",
            "CAST((o_orderkey * 37) % 2003 AS double) AS y",
            "CAST(o_custkey % 101 AS double) AS z",
            "CAST({days:o_orderdate} AS double) AS tim",
        ],
    ),
    "cloud": (
        "embeddings",
        ["CAST(vec_id AS bigint) AS id", "CAST(label AS bigint) AS tid", "CAST({at:0} AS double) * 1000 AS x", "CAST({at:1} AS double) * 1000 AS y", "CAST({at:2} AS double) * 1000 AS z"],
    ),
}


def _expressions(view: str, dialect: str) -> tuple[str, list[str]]:
    import re

    base, parts = VIEWS[view]
    words = DIALECT[dialect]
    out = []
    for p in parts:
        p = p.replace("{micros}", words["micros"]).replace("0D0", "0D" if dialect == "spark" else "0")
        p = re.sub(r"\{days:(\w+)\}", lambda m: words["days"].format(m[1]), p)
        p = re.sub(r"\{at:(\d+)\}", lambda m: words["at"].format(int(m[1]) + words["first"]), p)
        if dialect == "ansi" and "epoch_us" in p:
            p = p.replace("epoch_us(ts) / 1000000.0", "CAST(epoch_us(ts) AS double) / 1000000")
        out.append(p)
    return base, out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, parts = _expressions(name, "spark")
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*parts)


def sql(name: str) -> str:
    """The view as an ANSI sub-select."""
    base, parts = _expressions(name, "ansi")
    return f"(SELECT {', '.join(parts)} FROM {base})"
