"""A Spark session with the settings that the jobs expect; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "ledgerlake", cpus: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if cpus or "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus or '*'}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus or 8),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
