"""Session settings that the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sources of a scan are read side by side, each in a pool of its own.
    "spark.scheduler.mode": "FAIR",
    # Pages are large: keep the Arrow batches of the page walker small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def build_session(name: str = "postledger", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
