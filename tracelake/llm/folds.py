"""Folds by document id, and bounded samples of documents to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold -1, which is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))


def sample_ids(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` distinct ids, those with the smallest hashes: the same ones each time."""
    ids = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(most)


def sampled_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, partitions: int = 8) -> DataFrame:
    """``(text, *other columns of ids)``, one row for each of ``ids``, which has a bounded number of rows, hence the broadcast.

    Of rows with one id the text with the smallest hash is taken.
    """
    rest = [c for c in ids.columns if c != "id"]
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    one = found.groupBy("id", *rest).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("id", "text", *rest).repartition(partitions, "id")
