"""Spark session with the settings that every query assumes."""

from pyspark.sql import SparkSession


def build_session(app: str = "loomspan", master: str | None = None, **conf: str) -> SparkSession:
    """UTC clock, adaptive execution and skew handling; everything else is the caller's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
