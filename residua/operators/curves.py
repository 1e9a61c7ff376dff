"""Tie-exact ROC and precision-recall curves.

Samples are reduced to one row per distinct score before anything is ordered, and the order over
score groups is cut into buckets, so no task orders all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import DataError
from .held import materialized
from .prefix import bucketed, cumulative


def require_two_classes(samples: DataFrame, label: str) -> DataFrame:
    seen = samples.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"), F.count(F.lit(1)).alias("all")).first()
    if not seen["p"] or not seen["n"] or seen["p"] + seen["n"] != seen["all"]:
        raise DataError(f"labels must be 0 and 1 and hold both: {seen['p']} ones, {seen['n']} zeros of {seen['all']}")
    return samples


def _points(samples: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: counts of its group and of all groups from the highest score down to it."""
    groups = materialized(samples.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")))
    whole = groups.agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n"))
    cut = bucketed(groups, "threshold")
    return cumulative(cut, "threshold", ["_p", "_n"], descending=True, bucket=F.col("_bucket")).crossJoin(F.broadcast(whole)).withColumnsRenamed({"_p_upto": "tp", "_n_upto": "fp"})


def _rate(part: Column, whole: str) -> Column:
    return F.coalesce(F.try_divide(part, F.col(whole)), F.lit(0.0))


def curve_points(samples: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, tp, fp, fpr, tpr, precision per distinct score, from the highest down. The origin is left out."""
    tp, fp = F.col("tp"), F.col("fp")
    return _points(samples, label, score).select(
        "threshold", "tp", "fp", _rate(fp, "_all_n").alias("fpr"), F.try_divide(tp, F.col("_all_p")).alias("tpr"), F.try_divide(tp, tp + fp).alias("precision")
    )


def roc_pr_auc(samples: DataFrame, label: str, score: str) -> DataFrame:
    """roc_auc (trapezoid), pr_auc (steps), n, n_positive, prevalence, n_tied_score_groups.

    The point before a group's is the cumulative count less the group's own, so no row looks at another.
    Samples of one class have no curve: their evaluation fails. An empty table gives nulls.
    """
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "_p", "_n"))
    area = (_rate(fp, "_all_n") - _rate(fp - n, "_all_n")) * (_rate(tp, "_all_p") + _rate(tp - p, "_all_p")) / 2
    step = (_rate(tp, "_all_p") - _rate(tp - p, "_all_p")) * F.try_divide(tp, tp + fp)
    return _points(samples, label, score).agg(
        F.when((F.sum("_p") == 0) | (F.sum("_n") == 0), F.raise_error(F.lit("labels must hold both classes")).cast("double")).otherwise(F.sum(area)).alias("roc_auc"), F.sum(step).alias("pr_auc"), (F.sum("_p") + F.sum("_n")).alias("n"), F.sum("_p").alias("n_positive"),
        (F.sum("_p") / (F.sum("_p") + F.sum("_n"))).alias("prevalence"), F.count(F.lit(1)).alias("n_tied_score_groups"),
    )


def prevalence(samples: DataFrame, label: str) -> DataFrame:
    positives = F.count_if(F.col(label) == 1)
    return samples.agg(F.count(F.lit(1)).alias("n"), positives.alias("n_positive"), (positives / F.count(F.lit(1))).alias("rate"))


def auc_by_key(samples: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """roc_auc and pr_auc of each key, ties shared; null where a key has one class only.

    Each key's counts per distinct score are summed in buckets of the score: the totals of the buckets
    (64 a key) give each its start, and a window runs inside a key's bucket.
    """
    groups = samples.groupBy(key, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    cut = bucketed(materialized(groups), "_s")
    before = Window.partitionBy(key).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy(key)
    totals = cut.groupBy(key, "_bucket").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn"))
    starts = totals.select(
        F.col(key).alias("_key"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_sp"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_sn"),
        F.sum("_bp").over(of_key).alias("_all_p"), F.sum("_bn").over(of_key).alias("_all_n"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_at")))
    rows = joined.withColumn("_tp", F.sum("_p").over(inside) + F.col("_sp")).withColumn("_fp", F.sum("_n").over(inside) + F.col("_sn"))
    tp, p, n = F.col("_tp"), F.col("_p"), F.col("_n")
    area = F.sum(n * (2 * tp - p)) / (2 * F.max("_all_p") * F.max("_all_n"))
    steps = F.sum(F.try_divide(p * tp, tp + F.col("_fp"))) / F.max("_all_p")
    both = (F.max("_all_p") > 0) & (F.max("_all_n") > 0)
    return rows.groupBy(key).agg(F.when(both, area).alias("roc_auc"), F.when(both, steps).alias("pr_auc"))
