"""A Spark session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillrun", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=fixed | {k: str(v) for k, v in conf.items()}).getOrCreate()
