"""Run records: the newest match, timings, and best-so-far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .held import materialized
from .prefix import bucketed, ranked_by


def newest(runs: DataFrame, stamp: str, run: str, keys: Sequence[str] = (), where: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """The newest run of each key, ties by run, among those that match."""
    rows = runs if where is None else runs.filter(where)
    order = F.struct(stamp, run)
    return rows.groupBy(*keys).agg(F.max_by(run, order).alias(run), *(F.max_by(c, order).alias(c) for c in carry))


def timing_rollup(runs: DataFrame, name: str, seconds: str) -> DataFrame:
    """Total seconds, seconds per unit and hours by name."""
    return runs.groupBy(name).agg(F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("seconds_per_unit"), (F.sum(seconds) / 3600).alias("hours"))


def best_so_far(epochs: DataFrame, key: str, order: Sequence[str], score: str) -> DataFrame:
    """Running maximum, and whether a row improves on all before it. Rows without a score never count against it.

    The first of the order columns is a number or a time. It is cut into buckets, whose maxima (at most 64 a key)
    give each the best before it, so no task orders all rows of a key. The rows are evaluated once into scratch.
    """
    cut = bucketed(materialized(epochs), order[0])
    ahead = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(F.max(score).alias("_top")).select("_key", "_at", F.max("_top").over(ahead).alias("_before"))
    rows = cut.join(tops, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_at")))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    epochs = rows.withColumn("_earlier", F.greatest("_before", F.max(score).over(inside))).drop("_key", "_at", "_bucket", "_before")
    earlier = F.col("_earlier")
    best = F.greatest(F.coalesce(earlier, F.col(score)), F.col(score))
    return epochs.withColumn("best", F.coalesce(best, earlier)).withColumn("improved", F.coalesce((F.col(score) > earlier) | earlier.isNull(), F.lit(False)) & F.col(score).isNotNull()).drop("_earlier")


def stopped_at(epochs: DataFrame, key: str, order: Sequence[str], score: str, patience: int) -> DataFrame:
    """The first row of each key at which `patience` scored rows in a row have not improved.

    Rows are placed by buckets of the order; only improving rows, of which a key has few unless its score
    rises all the time, meet in one task.
    """
    marked = materialized(best_so_far(epochs.select(key, *order, score), key, order, score).filter(F.col(score).isNotNull()))
    placed = materialized(ranked_by(marked, [key], order[0], [F.col(c) for c in order[1:]]))
    ahead = Window.partitionBy(key).orderBy("_before")
    records = placed.filter("improved").select(key, "_before", "_all", F.lead("_before").over(ahead).alias("_next"))
    stale = records.filter(F.coalesce("_next", "_all") > F.col("_before") + patience)
    stop = stale.groupBy(F.col(key).alias("_key")).agg((F.min("_before") + patience).alias("_stop"))
    return placed.join(stop, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_before") == F.col("_stop"))).select(key, *order)


def ordered_digest(rows: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """SHA-256 of the items of each key, sorted and joined by commas. Items of a key are one video's frames."""
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.cast("string")), ","), 256).alias("digest"))


def mean_loss(epochs: DataFrame, key: str, loss: str) -> DataFrame:
    return epochs.groupBy(key).agg(F.avg(loss).alias("mean_loss"))


def l2_delta(rows: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col(after) - F.col(before), 2))).alias("l2_delta"))
