"""Slice-level reduction and its operating point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ConfigError


def slice_scores(voxels: DataFrame, keys: Sequence[str], flagged: Column, foreground: Column, truth: Column, min_voxels: int = 1, eps: float = 1e-8) -> DataFrame:
    """flagged_voxels, n_voxels, both fractions and the label of each slice that is not empty (one partial aggregate)."""
    n = F.count(F.lit(1))
    scores = voxels.groupBy(*keys).agg(
        F.count_if(flagged).alias("flagged_voxels"), n.alias("n_voxels"),
        (F.count_if(flagged) / n).alias("flagged_fraction"), (F.count_if(foreground) / n).alias("foreground_fraction"),
        (F.count_if(truth) >= min_voxels).cast("bigint").alias("label"),
    )
    return scores.filter(F.col("foreground_fraction") > eps)


def foreground_slices(voxels: DataFrame, keys: Sequence[str], foreground: Column, eps: float = 1e-8) -> DataFrame:
    return voxels.groupBy(*keys).agg((F.count_if(foreground) / F.count(F.lit(1))).alias("foreground_fraction")).filter(F.col("foreground_fraction") > eps)


def slice_label(voxels: DataFrame, keys: Sequence[str], truth: Column, min_voxels: int = 1) -> DataFrame:
    return voxels.groupBy(*keys).agg((F.count_if(truth) >= min_voxels).cast("bigint").alias("label"))


def slice_counters(voxels: DataFrame, volume: str, slice_key: str, foreground: Column) -> DataFrame:
    """Volumes, slices seen, dropped as empty, and kept, in one pass."""
    per_slice = voxels.groupBy(volume, slice_key).agg(F.count_if(foreground).alias("_f"))
    return per_slice.agg(
        F.count_distinct(volume).alias("n_volumes"), F.count(F.lit(1)).alias("n_seen"),
        F.count_if(F.col("_f") == 0).alias("n_dropped"), F.count_if(F.col("_f") > 0).alias("n_samples"),
    )


def confusion(rows: DataFrame, label: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; a ratio without denominator is 0."""
    counts = rows.groupBy(*keys).agg(
        F.count_if(predicted & label).alias("tp"), F.count_if(predicted & ~label).alias("fp"),
        F.count_if(~predicted & label).alias("fn"), F.count_if(~predicted & ~label).alias("tn"),
    )
    return with_ratios(counts)


def with_ratios(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of rows with tp, fp and fn; a ratio without denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def tune_slice_threshold(scores: DataFrame, grid: Sequence[float], split: str = "val") -> DataFrame:
    """precision, recall and f1 at each threshold of the grid (flagged_fraction >= t). Validation data only."""
    if split != "val":
        raise ConfigError(f"thresholds are chosen on val, not on {split}")
    label, fraction = F.col("label") == 1, F.col("flagged_fraction")
    sums = []
    for i, t in enumerate(grid):
        hit = fraction >= float(t)
        sums += [F.count_if(hit & label).alias(f"_tp{i}"), F.count_if(hit & ~label).alias(f"_fp{i}"), F.count_if(~hit & label).alias(f"_fn{i}"), F.count_if(~hit & ~label).alias(f"_tn{i}")]
    points = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"_{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(grid)))
    return with_ratios(scores.agg(*sums).select(F.inline(points)))
