"""Ranks with ties and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .held import materialized
from .prefix import cumulative, ranked_by


def average_ranks(rows: DataFrame, value: str, out: str, declared: bool = False) -> DataFrame:
    """The mean rank of equal values, from 1: counts per distinct value, and prefix sums over those.

    `declared` rows are those of a declaration (cells, folds), so few that one window holds them.
    """
    tally = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    if declared:
        upto = tally.withColumn("_n_upto", F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = cumulative(tally, value, ["_n"])
    return rows.join(upto.select(value, (F.col("_n_upto") - (F.col("_n") - 1) / 2).alias(out)), value)


def spearman(pairs: DataFrame, x: str, y: str, out: str = "rho", declared: bool = False) -> DataFrame:
    """Spearman's rho; null with fewer than three pairs or a constant side. Pairs with a null are left out; they are evaluated once."""
    rows = materialized(pairs.select(F.col(x).alias("_x"), F.col(y).alias("_y")).dropna())
    ranked = average_ranks(average_ranks(rows, "_x", "_rx", declared), "_y", "_ry", declared)
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), rho.alias("_rho")).select("n", F.when(F.col("n") >= 3, F.col("_rho")).alias(out))


def top_k_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def feature_rank(features: DataFrame, name: str, gain: str) -> DataFrame:
    """Features by mean gain, highest first, ties by name; a rank of all features, placed by buckets of the gain."""
    placed = ranked_by(materialized(features), [], gain, [F.col(name)], descending=True)
    return placed.withColumn("rank", (F.col("_before") + 1).cast("int")).drop("_before", "_all")


def mean_importance(gains: DataFrame, name: str = "feature", fold: str = "fold", gain: str = "gain") -> DataFrame:
    """Mean gain over all folds; a feature a fold did not use counts as 0 there."""
    folds = gains.select(fold).distinct()
    names = gains.select(name).distinct()
    grid = names.crossJoin(F.broadcast(folds))
    return grid.join(gains, [name, fold], "left").groupBy(name).agg(F.avg(F.coalesce(gain, F.lit(0.0))).alias("mean_gain"))
