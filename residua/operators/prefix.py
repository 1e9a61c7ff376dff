"""Prefix sums over a global order without a global sort task."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .held import materialized

BUCKETS = 64


def sortable(rows: DataFrame, order: str) -> Column:
    """The order as a number that rises with it: times in microseconds, dates in days."""
    kind = rows.schema[order].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(order)
    return F.unix_date(order) if isinstance(kind, T.DateType) else F.col(order)


def key_number(items: DataFrame, key: str) -> Column:
    """A number that never falls as the key rises: the key itself, or the first seven bytes in which string keys differ."""
    if not isinstance(items.schema[key].dataType, T.StringType):
        return F.col(key)
    low, high = items.agg(F.min(key), F.max(key)).first()
    shared = len(os.path.commonprefix([low or "", high or ""]))
    part = F.hex(F.encode(F.substring(key, shared + 1, 7), "UTF-8"))
    return F.conv(F.rpad(F.substring(part, 1, 14), 14, "0"), 16, 10).cast("bigint")


def bucketed(rows: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """Add `_bucket`, which rises with `order`, a number or a time, and is the same for equal values; nulls come first.

    The cuts, fewer than `buckets` numbers, are found at once by a pass over the column and stand in the plan as literals.
    """
    value = sortable(rows, order)
    probabilities = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    cuts = sorted(set(rows.agg(F.percentile_approx(value, probabilities, 10_000)).first()[0] or []))
    found = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)
    return rows.withColumn("_bucket", F.when(F.col(order).isNull(), 0).otherwise(found))


def octaves(value: Column, parts: int = 32) -> Column:
    """A bucket that rises with a double and needs no pass over the data: `parts` to each doubling, one for zero, NaN last.

    Numbers that spread over a few per cent or more of their size fall into many buckets, of which a key has 140,000 at most.
    """
    step = lambda x: F.floor(F.least(F.log2(x), F.lit(1025.0)) * parts) + 1100 * parts
    return F.when(F.isnan(value), F.lit(10**9)).when(value > 0, step(value)).when(value < 0, -step(-value)).otherwise(F.when(value.isNull(), F.lit(-(10**9))).otherwise(0))


def numbered(rows: DataFrame, order: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Add `out`: the place of each row, from 0, in order of a numeric column; equal values in any order among themselves."""
    cut = bucketed(rows, order, buckets)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = totals.select(F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    joined = cut.join(F.broadcast(starts), F.col("_bucket") == F.col("_at"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1 + F.col("_start")
    return joined.withColumn(out, place.cast("bigint")).drop("_bucket", "_at", "_start")


def cumulative(rows: DataFrame, order: str, sums: Sequence[str], descending: bool = False, buckets: int = BUCKETS, bucket: Column | None = None) -> DataFrame:
    """Add `<column>_upto` for each of sums: its total over the rows up to this one in order of distinct `order` values.

    Approximate quantiles cut the order into buckets, whose totals (a row per bucket, broadcast) give
    each bucket its start; inside a bucket a window runs. The quantiles shape the work, not the result.
    `bucket`, which must rise with the order, takes their place and saves a pass. Without it the rows,
    which should be narrow, are evaluated once into scratch.
    """
    cut = bucketed(materialized(rows), order, buckets) if bucket is None else rows.withColumn("_bucket", bucket)
    direction = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_bucket").agg(*(F.sum(c).alias(c) for c in sums))
    starts = totals.select(F.col("_bucket").alias("_at"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_start") for c in sums))
    inside = Window.partitionBy("_bucket").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(starts), F.col("_bucket") == F.col("_at"))
    added = joined.withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"_{c}_start") for c in sums})
    return added.drop("_bucket", "_at", *(f"_{c}_start" for c in sums))


def ranked_by(rows: DataFrame, keys: Sequence[str], order: str, then: Sequence[Column] = (), descending: bool = False, weight: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Add `_before` and `_all`: how many rows (or how much weight) of the same keys come before this row, and in all.

    Rows stand in order of a number or a time, ties by `then`. Buckets of the order, cut alike for all keys (by
    approximate quantiles, or by `bucket`, which must rise with the order and saves a pass), give each (keys, bucket) its start, so no task orders all rows of a key; keys may be null.
    """
    amount = F.lit(1) if weight is None else F.col(weight)
    cut = bucketed(rows, order) if bucket is None else rows.withColumn("_bucket", bucket)
    turn = lambda c: c.desc() if descending else c.asc()
    names = [f"_k{i}" for i in range(len(keys))]
    totals = cut.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_bucket").alias("_at")).agg(F.sum(amount).alias("_n"))
    earlier = Window.partitionBy(*names).orderBy(turn(F.col("_at"))).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*names, "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*names)).alias("_all"))
    match = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("_bucket") == F.col("_at")]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(turn(F.col(order)), *then).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(starts, match)
    return joined.withColumn("_before", F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.col("_start")).drop("_bucket", "_at", "_start", *names)
