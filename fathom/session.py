"""Session factory with the settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "fathom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on. `conf` uses double underscores for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in defaults.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
