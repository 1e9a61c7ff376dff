"""Batches of an epoch, numbered without a task that orders all items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ConfigError, DataError
from .prefix import key_number, ranked_by
from .validate import require_range, require_shape

SPLITS = ("train", "val", "test")


def epoch_batches(items: DataFrame, key: str, split: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Items with their `batch` and `place` in it, from 0: training items in order of a hash of seed, epoch and key, others by the key.

    The batches are the same however the items are partitioned. Ranks come from buckets of the order.
    The last batch may be short; items with an equal key stand in any order among themselves.
    """
    if split not in SPLITS:
        raise ConfigError(f"split is train, val or test, not {split!r}")
    if size < 1:
        raise ConfigError(f"a batch holds 1 item or more, not {size}")
    if split == "train":
        rows = items.withColumn("_order", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key).cast("string")))
        ranked = ranked_by(rows, [], "_order", [F.col(key)], bucket=F.shiftright("_order", 52))
    else:
        ranked = ranked_by(items.withColumn("_order", key_number(items, key)), [], "_order", [F.col(key)])
    at = F.col("_before")
    return ranked.withColumns({"batch": F.floor(at / size).cast("bigint"), "place": F.pmod(at, F.lit(size)).cast("bigint")}).drop("_order", "_before", "_all")


def require_first_batch(slices: DataFrame, batches: DataFrame, key: str, column: str, depth_multiple: int, pixels: int, element: str = "float") -> DataFrame:
    """The batches, if the volumes of batch 0 keep the contract: element type, shape, and values in [0, 1] without NaN.

    Only the slices of that batch are read.
    """
    require_element(slices, column, element)
    first = batches.filter("batch = 0").select(key)
    own = slices.join(first, key, "left_semi")
    if own.isEmpty():
        raise DataError("the first batch has no slices")
    require_shape(own, key, depth_multiple, pixels, column)
    require_range(own.select(F.explode(column).alias("v")), "v")
    return batches


def require_element(slices: DataFrame, column: str, element: str = "float") -> DataFrame:
    """The slices, if their arrays hold elements of that type."""
    found = slices.schema[column].dataType
    if not isinstance(found, T.ArrayType) or found.elementType.simpleString() != element:
        raise DataError(f"{column} must be array<{element}>, not {found.simpleString()}")
    return slices
