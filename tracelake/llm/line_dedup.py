"""Corpus-wide line deduplication on levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower
case.  ``LineRuns`` keeps, in the shared folder, runs of ``(h1, h2, n)``: the
128-bit hash of a key and the number of documents that hold it.  A batch of
documents is merge-anti-joined with the keys that the compacted runs have
settled as frequent, and what is left becomes a new sorted run of level 0.  As
soon as a level holds ``fanout`` runs they are merged into one run of the next
level, so a key is rewritten only once per level, and the settled keys are
looked up anew only then.

Everything is DataFrame code.  Counting pre-aggregates in the map tasks, so a
line that every document holds costs one row per task.

Defined results: a null text is one empty line; an empty key is never dropped;
rows with equal id (null included) and equal text are one document, and each
row gets its own output row; an empty table gives an
empty result.  The columns ``n_lines``, ``n_dropped`` and ``kept`` replace input
columns of these names; all others stay, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import WHITE, ascii_lower, shared_dir, stored


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line):
    return F.btrim(ascii_lower(line), F.lit(WHITE))


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``(id, th, h1, h2, at)``: one row for each different key of each document, with the places of its lines.

    A document's rows meet in its own task before the shuffle.
    """
    text = F.col(text_col)
    each = docs.select(F.col(id_col).alias("id"), _text_hash(text).alias("th"), F.posexplode(F.transform(_lines(text), _key)).alias("pos", "key"))
    hashed = each.where(F.char_length("key") >= min_chars).select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    return hashed.groupBy("id", "th", "h1", "h2").agg(F.collect_set("pos").alias("at"))


class LineRuns:
    """Levelled sorted runs of line hashes with their document counts."""

    SCHEMA = "h1 long, h2 long, n long"

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.settled: DataFrame | None = None

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.root}/{level}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)

    def counts(self) -> DataFrame:
        """``(h1, h2, n)`` over all runs."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.min_docs).select("h1", "h2")

    def ingest(self, keys: DataFrame) -> None:
        """Adds a batch of ``line_keys``. Keys that are settled as frequent need no more counting."""
        new = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        if self.settled is not None:
            known = self.settled.hint("merge")
            # the condition on n keeps the join above the counting, whose map side makes a hot line one row a task
            new = new.join(known, (new["h1"] == known["h1"]) & (new["h2"] == known["h2"]) & (new["n"] > 0), "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one run of the next; keys that are frequent by now are settled."""
        runs = self.spark.read.schema(self.SCHEMA).parquet(*self.levels[level])
        self._write(runs.groupBy("h1", "h2").agg(F.sum("n").alias("n")), level + 1)
        self.levels[level] = []
        merged = self.spark.read.schema(self.SCHEMA).parquet(*(p for paths in self.levels[level + 1 :] for p in paths))
        self.settled = stored(merged.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select("h1", "h2"), "settled-lines")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 5,
    fanout: int = 4,
) -> DataFrame:
    """``docs`` with columns ``n_lines``, ``n_dropped`` and ``kept`` (the text left).

    Every line whose key occurs in at least ``min_docs`` documents is dropped
    everywhere.  ``batches`` splits the table as if it arrived in that many
    parts; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    keys = stored(line_keys(docs, id_col, text_col, min_chars).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "line-keys", by=["part"])
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.ingest(keys.where(F.col("part") == b))
    frequent = stored(runs.frequent(), "frequent-lines")
    hits = keys.join(frequent, ["h1", "h2"], "left_semi").groupBy("id", "th").agg(F.flatten(F.collect_list("at")).alias("gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id_"), _text_hash(F.col(text_col)).alias("th_"), _lines(F.col(text_col)).alias("lines"))
    joined = held.join(hits, F.col("id_").eqNullSafe(hits["id"]) & (F.col("th_") == hits["th"]), "left")
    # the places left, through a hash set, whatever the number of lines; at least the empty list for none
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    out = joined.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("left"))
    return out.select(
        *(F.col("row")[c].alias(c) for c in names), "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT doc_id, i, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
