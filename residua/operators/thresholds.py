"""Residual thresholds and the choice of an operating point."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import ConfigError
from .metrics import dice_of
from .held import materialized
from .prefix import octaves, ranked_by


def absolute_mask(residual: Column, value: float) -> Column:
    """Strictly above the value; NaN is never above."""
    return (residual > value) & ~F.isnan(residual)


#: Places of the flat index that are numbered together.
BLOCK = 1 << 16


def kept_count(n: Column, percentile: float | Column) -> Column:
    return F.rint(n * (F.lit(100.0) - percentile) / 100.0).cast("bigint")


def percentile_mask(voxels: DataFrame, key: str, flat_index: str, percentile: float, residual: str = "residual") -> DataFrame:
    """`flagged`: exactly round-half-even(n (100 - p) / 100) highest residuals per volume, ties by flat index.

    Counts per octave of the residual tell in which octave the cut of each volume lies. Only the voxels
    of that octave are counted by value, which gives the cut, and only those tied at the cut are numbered,
    by blocks of the flat index; a background of equal values is such a tie. So no task sorts a volume.
    """
    if not 0 <= percentile <= 100:
        raise ConfigError(f"percentile must lie in [0, 100], not {percentile}")
    at = voxels.select(key, flat_index, residual).withColumn("_octave", octaves(F.col(residual)))
    higher = Window.partitionBy(key).orderBy(F.desc("_octave")).rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy(key, "_octave").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(higher), F.lit(0)), "_k": kept_count(F.sum("_n").over(Window.partitionBy(key)), percentile)})
    octave = placed.filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") >= F.col("_k"))).select(key, "_octave", (F.col("_k") - F.col("_before")).alias("_k"))
    tally = at.join(octave, [key, "_octave"]).groupBy(key, residual, "_k").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked_by(materialized(tally), [key], residual, descending=True, weight="_n", bucket=octaves(F.col(residual), 1 << 14))
    cut = ranked.filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") >= F.col("_k")))
    cut = materialized(cut.select(key, F.col(residual).alias("_cut"), (F.col("_k") - F.col("_before")).alias("_ties"), (F.col("_n") + F.col("_before") == F.col("_k")).alias("_all_tied")))
    tied = at.join(cut.filter("not _all_tied"), key).filter(F.col(residual) == F.col("_cut"))
    numbered = ranked_by(tied.select(key, flat_index, "_ties"), [key], flat_index, bucket=F.floor(F.col(flat_index) / BLOCK))
    last = numbered.filter(F.col("_before") == F.col("_ties") - 1).select(key, F.col(flat_index).alias("_last"))
    marked = voxels.join(cut.join(last, key, "left"), key, "left")
    of_tie = (F.col(residual) == F.col("_cut")) & (F.col("_all_tied") | (F.col(flat_index) <= F.col("_last")))
    return marked.withColumn("flagged", F.coalesce((F.col(residual) > F.col("_cut")) | of_tie, F.lit(False))).drop("_cut", "_ties", "_all_tied", "_last")


def percentile_mask_rows(slices: DataFrame, key: str, percentile: float, residual: str = "residual") -> DataFrame:
    """The same rule over slice rows, a volume per group: for volumes that fit a task (2.6 M voxels, 10 MB)."""

    def mask(group: pa.Table) -> pa.Table:
        group = group.sort_by("slice_index")
        arrays = [np.asarray(x, np.float32) for x in group.column(residual).to_pylist()]
        flat = np.concatenate(arrays) if arrays else np.array([], np.float32)
        k = int(np.rint(len(flat) * (100.0 - percentile) / 100.0))
        out = np.zeros(len(flat), np.int8)
        out[np.argsort(-flat, kind="stable")[:k]] = 1
        parts = np.split(out, np.cumsum([len(a) for a in arrays])[:-1]) if arrays else []
        return pa.table({key: group.column(key), "slice_index": group.column("slice_index"), "mask": pa.array(parts, pa.list_(pa.int8()))})

    kind = slices.schema[key].dataType.simpleString()
    rows = slices.select(key, F.col("slice_index").cast("bigint").alias("slice_index"), residual)
    return rows.groupBy(key).applyInArrow(mask, f"{key} {kind}, slice_index bigint, mask array<tinyint>")


def otsu_cutoffs(voxels: DataFrame, key: str, bins: int = 256, residual: str = "residual") -> DataFrame:
    """(key, cutoff): the centre of the bin that maximises the between-class variance; lowest bin on ties.

    Constant volumes have no row. Voxels are reduced to at most `bins` counts per volume before any window.
    """
    if bins < 2:
        raise ConfigError(f"bins must be 2 or more, not {bins}")
    extrema = voxels.groupBy(key).agg(F.min(residual).alias("_lo"), F.max(residual).alias("_hi")).filter("_hi > _lo")
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = voxels.join(extrema, key).withColumn("_bin", F.least(F.floor((F.col(residual) - F.col("_lo")) / width), F.lit(bins - 1)))
    hist = binned.groupBy(key, "_lo", "_hi", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    centre = F.col("_lo") + width * (F.col("_bin") + 0.5)
    h = hist.withColumn("_p", F.col("_n") / F.sum("_n").over(whole)).withColumn("_centre", centre)
    h = h.withColumn("_wb", F.sum("_p").over(upto)).withColumn("_m", F.sum(F.col("_p") * F.col("_centre")).over(upto))
    h = h.withColumn("_total", F.sum(F.col("_p") * F.col("_centre")).over(whole)).withColumn("_wf", 1 - F.col("_wb"))
    split = h.filter("_wb > 1e-12 and _wf > 1e-12")
    between = F.col("_wb") * F.col("_wf") * F.pow(F.col("_m") / F.col("_wb") - (F.col("_total") - F.col("_m")) / F.col("_wf"), 2)
    return split.groupBy(key).agg(F.max_by("_centre", F.struct(F.round(between, 12), (-F.col("_bin")).alias("_b"))).alias("cutoff"))


def otsu_mask(voxels: DataFrame, key: str, bins: int = 256, residual: str = "residual") -> DataFrame:
    cut = otsu_cutoffs(voxels, key, bins, residual)
    return voxels.join(cut, key, "left").withColumn("flagged", F.coalesce(absolute_mask(F.col(residual), F.col("cutoff")), F.lit(False))).drop("cutoff")


def sweep_grid(spark, percentiles: Sequence[float], absolutes: Sequence[float]) -> DataFrame:
    rows = [(i, "percentile", float(p)) for i, p in enumerate(percentiles)]
    rows += [(len(rows) + i, "absolute", float(a)) for i, a in enumerate(absolutes)]
    return spark.createDataFrame(rows, "point int, strategy string, value double")


def threshold_sweep(voxels: DataFrame, key: str, flat_index: str, percentiles: Sequence[float], absolutes: Sequence[float], residual: str = "residual", truth: str = "gt", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of Dice over volumes for each threshold, and each value of `by`.

    Volumes are ranked once; every threshold is a conditional sum of one pass, so residuals are
    neither recomputed nor multiplied by the grid.
    """
    ranked = ranked_by(voxels, [*by, key], residual, [F.col(flat_index)], descending=True, bucket=octaves(F.col(residual)))
    tests = [(F.col("_before") < kept_count(F.col("_all"), p)) for p in percentiles] + [absolute_mask(F.col(residual), a) for a in absolutes]
    hit = F.col(truth) > 0
    sums = []
    for i, test in enumerate(tests):
        sums += [F.count_if(test & hit).alias(f"_i{i}"), F.count_if(test).alias(f"_p{i}")]
    per_volume = ranked.groupBy(*by, key).agg(F.count_if(hit).alias("_g"), *sums)
    points = F.array(*(F.struct(F.lit(i).alias("point"), dice_of(F.col(f"_i{i}"), F.col(f"_p{i}"), F.col("_g")).alias("dice")) for i in range(len(tests))))
    scores = per_volume.select(*by, key, F.inline(points))
    grid = F.broadcast(sweep_grid(voxels.sparkSession, percentiles, absolutes))
    return scores.join(grid, "point").groupBy(*by, "strategy", "value").agg(F.avg("dice").alias("dice_mean"), F.stddev_pop("dice").alias("dice_std"), F.count(F.lit(1)).alias("n_volumes"))


def select_operating_point(sweep: DataFrame, split: str = "val") -> DataFrame:
    """The point with the highest mean Dice, the lowest value on ties. Only validation data may choose it."""
    if split != "val":
        raise ConfigError(f"thresholds are chosen on val, not on {split}")
    return sweep.orderBy(F.round("dice_mean", 9).desc(), "value", "strategy").limit(1)
