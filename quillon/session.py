"""Session construction with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillon.plans.ship import ship_package


def build_session(master: str | None = None, app: str = "quillon", **extra: str) -> SparkSession:
    """A session with UTC timestamps, AQE and Arrow; `extra` wins over the defaults (dots as `__`).

    On a cluster leave `master` empty so that spark-submit decides.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    conf |= {k.replace("__", "."): v for k, v in extra.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=conf).getOrCreate()
    ship_package(spark)
    return spark
