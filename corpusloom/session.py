"""A session with the settings that the operators' results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """UTC, adaptive execution, and later map keys winning."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()
