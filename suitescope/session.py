"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "suitescope", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; shuffle partitions and memory are left to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
