"""Session settings that results depend on, and those that matter for speed."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quartzite", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings override."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=conf | settings).getOrCreate()
