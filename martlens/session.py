"""A Spark session with the engine's settings; a session that exists already is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "martlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
                "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
