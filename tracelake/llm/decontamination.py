"""Benchmark decontamination by winnowed fingerprints, extended to exact windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z become lower case.
A window is ``window`` consecutive words of an item (all words of a shorter
item).  Every document word inside an occurrence of a window is a hit.

1. Winnowing: of each run of ``window - k + 1`` consecutive k-gram hashes the
   smallest is kept, for documents and items alike, so any shared span of
   ``window`` words shares a fingerprint.  Items of fewer words are found by
   the hash of all their words among the document's grams of that many words.
2. Fingerprints of both sides are joined.  The item side is broadcast only if
   it is counted to be small; beyond that it is a shuffled join, which the
   adaptive planner splits where one fingerprint is hot.
3. Extension: in the documents that share a fingerprint, all windows are hashed
   (128 bits) and joined with the items' windows; the hits of a document are
   merged to covered words.

Only documents that share a fingerprint are exploded to windows.  Item ids are
attached to a window as one list, so a document hit yields one row, however
many items hold that window.

Defined results: a null text has no words and no hits; items without words are
ignored; items with equal ids count once; rows with equal id (null included) and
equal text are one document, and each row gets its own output row; empty tables
give empty or hit-free results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, let, stored

WORD_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAPS, -1), lambda w: w != "")


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; fewer words give none."""
    grams = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))))
    return F.slice(grams, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def winnow(hashes: Column, w: int) -> Column:
    """The smallest of each w consecutive hashes, each value once."""
    low = F.transform(hashes, lambda h, i: F.least(h, *(F.get(hashes, i + j) for j in range(1, w))))
    return F.array_distinct(F.slice(low, 1, F.greatest(F.size(hashes) - (w - 1), F.lit(1))))


def item_windows(items: DataFrame, window: int, item_id: str, text_col: str) -> DataFrame:
    """``(n, h1, h2, items)``: each window's length, hashes and the ids of the items that hold it."""
    words = items.select(F.col(item_id).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    return (
        words.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("g"))
        .select("item", "n", F.xxhash64(F.array_join("g", " ")).alias("h1"), F.xxhash64(F.lit(1), F.array_join("g", " ")).alias("h2"))
        .groupBy("n", "h1", "h2")
        .agg(F.collect_set("item").alias("items"))
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """``(id_col, n_words, n_hit, items)`` for each document row; ``items`` is the sorted list of item ids."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    item_words = items.select(words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    wins = stored(item_windows(items, window, item_id, item_text), "item-windows")
    span = window - k + 1
    long_fp = item_words.where(F.size("w") >= window).select(F.explode(winnow(gram_hashes(F.col("w"), k), span)).alias("f"))
    short = item_words.where(F.size("w") < window)
    lengths = sorted(r["n"] for r in wins.where(F.col("n") < window).select("n").distinct().collect())  # window - 1 values at most
    prints = long_fp
    for m in lengths:
        prints = prints.union(short.where(F.size("w") == m).select(F.explode(gram_hashes(F.col("w"), m))))
    prints = stored(prints.distinct(), "item-fingerprints")

    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")).alias("id")
    base = docs.select(key, words_of(F.col(text_col)).alias("w"))
    own = let(gram_hashes(F.col("w"), k), lambda h: winnow(h, span))
    for m in lengths:
        own = F.concat(own, gram_hashes(F.col("w"), m))
    marked = base.select("id", F.explode(own).alias("f")).join(small(prints), "f", "left_semi").select("id").distinct()
    marked = stored(marked, "marked-documents")

    near = docs.select(key, F.col(text_col).alias("t")).join(marked, "id", "left_semi").select("id", words_of(F.col("t")).alias("w"))

    def windows(n: int) -> DataFrame:
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return near.where(F.size("w") >= n).select("id", F.lit(n).alias("n"), F.posexplode(grams).alias("p", "g"))

    grams = reduce(DataFrame.union, map(windows, [*lengths, window]))
    hits = grams.select("id", "n", "p", F.xxhash64("g").alias("h1"), F.xxhash64(F.lit(1), F.col("g")).alias("h2")).join(small(wins), ["n", "h1", "h2"])

    def covered(spans: Column) -> Column:
        """Words inside the union of (start, end) spans, which come sorted."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            spans,
            start,
            lambda a, s: F.struct((a.n + F.greatest(s.end - F.greatest(s.p, a.end), F.lit(0))).alias("n"), F.greatest(a.end, s.end).alias("end")),
            lambda a: a.n,
        )

    per_doc = stored(
        hits.groupBy("id")
        .agg(
            F.sort_array(F.collect_set(F.struct("p", (F.col("p") + F.col("n")).alias("end")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select(F.col("id").alias("__id"), covered(F.col("spans")).cast("long").alias("n_hit"), "items"),
        "document-hits",
    )
    counted = docs.select(F.col(id_col), key.alias("__key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = counted.join(per_doc, F.col("__key") == F.col("__id"), "left")
    return out.select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n.n AS n, unnest(range(1, len(w) - n.n + 2)) AS i FROM d, n WHERE len(w) >= n.n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
