"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Event times are compared and windowed in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Partition counts are left to run-time statistics; hot join partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Catalog-sized tables, whose size is known since they are written first, go to every executor.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STATE_STORE = {
    # Keyed stream state lives on disk, so it is not bounded by executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "lumigrid", cpus: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings above.

    ``cpus`` asks for local mode; without it the master is whatever ``spark-submit`` chose.
    """
    builder = SparkSession.builder.appName(app)
    settings = {**SETTINGS, **STATE_STORE}
    if cpus:
        builder = builder.master(f"local[{cpus}]")
        settings["spark.sql.shuffle.partitions"] = str(cpus)
        settings["spark.ui.enabled"] = "false"
        settings["spark.driver.memory"] = "12g"
    for key, value in {**settings, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
