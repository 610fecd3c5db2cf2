"""What the text operators share: tables in the shared folder and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracelake.storage import shared_dir, stored

__all__ = ["LOWER", "UPPER", "WHITE", "ascii_lower", "let", "shared_dir", "shuffle_count", "stored"]

#: The six ASCII white-space characters: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, other letters as they are. Pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
