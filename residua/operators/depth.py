"""Which slices of a volume to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_area(areas: DataFrame, item: str, area: str) -> DataFrame:
    """The item with the largest area; the smallest item on ties."""
    return areas.agg(F.min_by(item, F.struct(-F.col(area), item)).alias(item), F.max(area).alias(area))


def nonzero_depths(voxels: DataFrame, volume: str, value: str, min_intensity: float) -> DataFrame:
    return voxels.groupBy(volume, "slice_index").agg(F.max(value).alias("peak")).filter(F.col("peak") > min_intensity).select(volume, "slice_index")


def truth_window(voxels: DataFrame, volume: str, truth: Column, window: int) -> DataFrame:
    """Slices lo .. hi - 1 of a window centred on the slice with the largest truth area, moved inside the volume."""
    area = voxels.groupBy(volume, "slice_index").agg(F.count_if(truth).alias("_a"))
    per = area.groupBy(volume).agg(F.min_by("slice_index", F.struct(-F.col("_a"), "slice_index")).alias("centre"), F.max("_a").alias("_best"), (F.max("slice_index") + 1).alias("depth")).filter("_best > 0")
    start = F.greatest(F.col("centre") - window // 2, F.lit(0))
    hi = F.least(F.col("depth"), start + window)
    return per.select(volume, "centre", F.greatest(F.lit(0).cast("bigint"), hi - window).alias("lo"), hi.alias("hi"))


def explicit_depths(slices: DataFrame, start: int, stop: int) -> DataFrame:
    return slices.filter(F.col("slice_index").between(start, stop))


def with_fallback(first: DataFrame, second: DataFrame, volume: str, least: int = 2) -> DataFrame:
    """Slices of the first policy where it yields enough, else those of the second."""
    enough = first.groupBy(volume).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(volume)
    return first.join(enough, volume, "left_semi").unionByName(second.join(enough, volume, "left_anti"))


def stride_subsample(depths: DataFrame, volume: str, max_frames: int) -> DataFrame:
    """At most max_frames slices at a uniform stride: positions floor(i * n / max_frames)."""
    per = Window.partitionBy(volume)
    ranked = depths.withColumn("_i", F.row_number().over(per.orderBy("slice_index")) - 1).withColumn("_n", F.count(F.lit(1)).over(per))
    i, n = F.col("_i"), F.col("_n")
    # The frame that could pick position i is the first one at or after it.
    frame = F.ceil(i * max_frames / n)
    picked = (frame < max_frames) & (F.floor(frame * (n / max_frames)) == i)
    return ranked.filter((n <= max_frames) | picked).drop("_i", "_n")
