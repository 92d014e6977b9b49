"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "evalspark", **conf) -> SparkSession:
    """A session in UTC with adaptive plans and ANSI arithmetic; other settings by name, with _ for the dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
