"""A Spark session with the settings that the engine's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """Adaptive execution on (coalescing, skewed joins), UTC, Arrow; further settings by keyword with '__' for '.'."""
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
