"""A session with the settings the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "folioflow", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; conf adds or replaces settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
