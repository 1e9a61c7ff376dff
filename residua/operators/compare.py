"""Comparisons that keep absence apart from zero: a missing value is null and carries a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ArtifactError
from ..functions import scalar


def declared_left_join(declared: DataFrame, observed: DataFrame, keys: Sequence[str], value: str, reason: str = "not evaluated") -> DataFrame:
    """Every declared cell with its value, or null and na_reason."""
    joined = declared.join(observed, list(keys), "left")
    return joined.withColumn("na_reason", F.when(F.col(value).isNull(), F.lit(reason)))


def rendered(cells: DataFrame, keys: Sequence[str], value: str, places: int = 4) -> DataFrame:
    return cells.select(*keys, scalar.render_na(F.col(value), F.col("na_reason"), places).alias("rendered"))


def availability(cells: DataFrame, value: str) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("n_total"), F.count(value).alias("n_available"), F.count_if(F.col(value).isNull()).alias("n_missing"))


def best_cell(cells: DataFrame, value: str, order: Sequence[Column]) -> DataFrame:
    """The highest value; of equal ones the first in declared order."""
    return cells.filter(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *order).limit(1)


def invalid_cells(aggregates: DataFrame, expected: Column) -> DataFrame:
    """Rows that fail the expectation or leave it unknown."""
    return aggregates.filter(~F.coalesce(expected, F.lit(False)))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def sample_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*keys).join(right.select(*keys), list(keys), "left_anti")


def require_same_samples(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Raise with the first five keys that either side lacks."""
    for a, b, what in ((left, right, "missing"), (right, left, "extra")):
        found = sample_difference(a, b, keys).orderBy(*keys).limit(5).collect()
        if found:
            raise ArtifactError(f"{what} samples: {[tuple(r) for r in found]}")


def label_disagreement(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str, other: str) -> DataFrame:
    return left.join(right, list(keys)).filter(F.col(label) != F.col(other))


def half_present(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on exactly one side."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return a.join(b, list(keys), "full_outer").filter(F.col("_l").isNull() | F.col("_r").isNull()).withColumn("side", F.when(F.col("_l").isNull(), "right").otherwise("left")).drop("_l", "_r")


def split_hash_agreement(runs: DataFrame, key: str, digest: Column) -> DataFrame:
    return runs.groupBy(key).agg(F.count_distinct(digest).alias("n_hashes")).withColumn("agrees", F.col("n_hashes") <= 1)


def label_override(rows: DataFrame, overrides: DataFrame, key: str, label: str, default: Column, required: bool = False) -> DataFrame:
    """The override's label where there is one, else the default; where overrides are `required`, a key without one raises when it is read."""
    held = overrides.select(key, F.col(label).alias("_label"), F.lit(True).alias("_held"))
    joined = rows.join(held, key, "left")
    chosen = F.coalesce("_label", default)
    if required:
        missing = F.raise_error(F.concat(F.lit("no label override for "), F.col(key).cast("string")))
        chosen = F.when(F.col("_held").isNull(), missing.cast(joined.select(chosen).schema[0].dataType)).otherwise(chosen)
    return joined.withColumn("label", chosen).drop("_label", "_held")


def controlled_pairs(cells: DataFrame, side: str, before: str, after: str, keys: Sequence[str], controls: Sequence[str], value: str) -> DataFrame:
    """before, after, delta for pairs that agree, nulls included, in all controls; a fall is a regression."""
    names = [*keys, *controls]
    b = cells.filter(F.col(side) == before).select(*(F.col(c).alias(f"_b_{c}") for c in names), F.col(value).alias("before"))
    a = cells.filter(F.col(side) == after).select(*names, F.col(value).alias("after"))
    match = [F.col(c) == F.col(f"_b_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in controls]
    joined = b.join(a, [*match])
    delta = F.col("after") - F.col("before")
    return joined.select(*names, "before", "after", delta.alias("delta"), F.when(delta < 0, "REGRESSION").otherwise("ok").alias("flag"))


def scorecard(spine: DataFrame, sources: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """metric, value, na_reason for each (metric, one-row frame, value column) joined to a one-row spine."""
    row = spine
    for metric, frame, value in sources:
        row = row.join(F.broadcast(frame.select(F.lit(1).alias("_one"), F.col(value).cast("double").alias(metric))), F.lit(1) == F.col("_one"), "left").drop("_one")
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m, _, _ in sources))
    return row.select(F.inline(entries)).withColumn("na_reason", F.when(F.col("value").isNull(), "source is missing"))


def set_except(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def set_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def must_match(aggregates: DataFrame, runs: DataFrame, key: str, carry: Sequence[str]) -> DataFrame:
    """Each aggregate with the carried columns of its run record; one without a record fails when it is read."""
    found = runs.select(F.col(key).alias("_run"), *carry)
    joined = aggregates.join(found, F.col(key) == F.col("_run"), "left")
    checked = F.when(F.col("_run").isNull(), F.raise_error(F.concat(F.lit("no run record for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col("_run"))
    return joined.withColumn(key, checked.cast(aggregates.schema[key].dataType)).drop("_run")


def traced_scorecard(entries: DataFrame, reasons: DataFrame) -> DataFrame:
    """metric, value, source, na_reason of each metric in reasons (metric, na_reason).

    entries (metric, priority, source, split_hash, value): of the sources that have a value the one with the
    lowest priority stands, ties by source. A value without a source is an error when it is read. Where sources
    were made under different splits no value stands, and the reason says so; a null hash agrees with any.
    """
    held = F.when(F.col("value").isNotNull() & F.col("source").isNull(), F.raise_error(F.lit("a value has no source")).cast("double")).otherwise(F.col("value"))
    present = entries.withColumn("value", held).filter(F.col("value").isNotNull())
    best = present.groupBy("metric").agg(F.min_by(F.struct("value", "source"), F.struct("priority", "source")).alias("_best"))
    splits = entries.agg((F.count_distinct("split_hash") > 1).alias("_mixed"))
    joined = reasons.join(best, "metric", "left").crossJoin(F.broadcast(splits))
    value = F.when(~F.col("_mixed"), F.col("_best.value"))
    reason = F.when(F.col("_mixed"), F.lit("sources differ in their splits")).when(F.col("_best").isNull(), F.col("na_reason"))
    return joined.select("metric", value.alias("value"), F.when(value.isNotNull(), F.col("_best.source")).alias("source"), reason.alias("na_reason"))


def require_complete(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Raise with the first five keys that only one side has."""
    found = half_present(left, right, keys).orderBy(*keys).limit(5).collect()
    if found:
        raise ArtifactError(f"present on one side only: {[tuple(r) for r in found]}")
