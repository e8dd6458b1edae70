"""Session settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Everything else (memory, cluster manager, checkpoint folder) is the cluster's to say.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "corvane", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings. The time zone follows CORVANE_TIMEZONE where that is set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | ({"spark.sql.session.timeZone": tz} if (tz := os.environ.get("CORVANE_TIMEZONE")) else {}) | extra
    return builder.config(map=settings).getOrCreate()
