"""Session settings for large inputs; local masters get few shuffle partitions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "loamix", cpus: int | None = None, **conf: str) -> SparkSession:
    """Without ``cpus`` the master comes from the environment that submits the program."""
    builder = SparkSession.builder.appName(app)
    settings = DEFAULTS | conf
    if cpus:
        builder = builder.master(f"local[{cpus}]")
        settings = {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": os.environ.get("LOAMIX_DRIVER_MEMORY", "8g"), "spark.ui.enabled": "false"} | settings
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
