"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillon", **conf: str) -> SparkSession:
    """A session with the settings the engine assumes: UTC and adaptive execution, which also splits
    skewed joins. ``conf`` uses dots as double underscores; settings of the cluster win otherwise."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
