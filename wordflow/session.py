"""A session with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC, Arrow on; everything else as the cluster sets it."""
    builder = SparkSession.builder.appName("wordflow")
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
