"""SparkSession builder with the settings the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "inkfield", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session on `master` (or what spark-submit gives). Cluster settings that are set elsewhere win over none of these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory or "local" in (master or ""):
        builder = builder.config("spark.driver.memory", memory or os.environ.get("INKFIELD_DRIVER_MEMORY", "8g"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str):
    """Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
