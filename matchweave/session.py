"""Session builder with settings that suit event data of any size."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "matchweave", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on (partitions merged, skewed joins split), UTC, Arrow for pandas exchange.

    ``conf`` keys use double underscores for dots. The number of shuffle
    partitions is left to AQE unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
