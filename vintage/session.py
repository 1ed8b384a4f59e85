"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "vintage", **settings: str) -> SparkSession:
    """UTC, adaptive plans; settings override, a running session is reused."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
