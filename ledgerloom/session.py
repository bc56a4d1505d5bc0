"""A session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps date arithmetic the same everywhere. Adaptive execution sizes
# shuffles, replaces joins by broadcasts once a side has proven small, and
# splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "ledgerloom", **settings: str) -> SparkSession:
    """``settings`` use ``__`` for ``.``, e.g. ``spark__sql__shuffle__partitions="2000"``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
