"""A session with the settings that the operators assume; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Python sources of volumes prune files and slices by filters.
    "spark.sql.python.filterPushdown.enabled": "true",
    # State of any shape, with timers, needs this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A slice row may hold tens of kilobytes per array.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions or cores)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
