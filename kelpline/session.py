"""The Spark session that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "kelpline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, in which checkpoints go when nothing reads them; other settings by keyword, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
