"""A session with the settings that this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tracelake", **settings: str) -> SparkSession:
    """UTC times, adaptive execution; everything else comes from the cluster or from ``settings``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
