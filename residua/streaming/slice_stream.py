"""Slice scores of results as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_slice_scores(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], cut: float, files_per_trigger: int = 16) -> DataFrame:
    """flagged_voxels, n_voxels and flagged_fraction per slice row (array column `residual`).

    A slice is one row, so the map has no state and needs no watermark; append mode and exactly-once
    file sinks hold.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    flagged = F.size(F.filter("residual", lambda r: (r > cut) & ~F.isnan(r)))
    return rows.select(*keys, flagged.alias("flagged_voxels"), F.size("residual").alias("n_voxels"), (flagged / F.size("residual")).alias("flagged_fraction"))
