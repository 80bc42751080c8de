"""Session settings for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC, Arrow and dynamic partition overwrite."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
