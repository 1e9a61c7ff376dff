"""Volume preprocessing over voxel rows (subject, slice_index, y, x, v) and slice rows.

Keys are parameters; per-volume extrema are partial aggregates joined back, so a volume never has to
fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import CHUNK_DEPTH, RANGE_EPS, ConfigError, DataError
from ..functions import scalar
from .held import materialized
from .prefix import key_number, ranked_by


def permute_axes(voxels: DataFrame, order: Sequence[str], names: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Rename axis columns: order tells which old axis becomes each of names."""
    others = [c for c in voxels.columns if c not in order]
    return voxels.select(*others, *(F.col(old).alias(new) for old, new in zip(order, names, strict=True)))


def crop_box(voxels: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Keep voxels inside half-open bounds and re-index each axis from zero."""
    for axis, (start, stop) in bounds.items():
        voxels = voxels.filter((F.col(axis) >= start) & (F.col(axis) < stop)).withColumn(axis, F.col(axis) - start)
    return voxels


def binarize(label: Column) -> Column:
    return (label > 0).cast("tinyint")


def minmax_volume(voxels: DataFrame, key: str = "subject", value: str = "v", eps: float = RANGE_EPS, out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min + eps) per volume; with eps 0 a constant volume gives null."""
    extrema = voxels.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo") + eps)
    return voxels.join(extrema, key).withColumn(out, scaled).drop("_lo", "_hi")


def _axis_weights(voxels: DataFrame, axis: str, size: int, out: int) -> DataFrame:
    """A row per (output index, source index, weight): at most 2 * out rows."""
    rows = []
    for o in range(out):
        src = max((o + 0.5) * size / out - 0.5, 0.0)
        low = min(int(src), size - 1)
        high, w = min(low + 1, size - 1), src - low
        weights = {low: 1 - w}
        weights[high] = weights.get(high, 0.0) + w
        rows += [(o, i, x) for i, x in weights.items() if x]
    return voxels.sparkSession.createDataFrame(rows, f"_o{axis} long, {axis} long, _w{axis} double")


def resize_bilinear(voxels: DataFrame, keys: Sequence[str], size: int, out: int, value: str = "v") -> DataFrame:
    """Separable bilinear resize of square slices, half-pixel centres, clamped at the low edge."""
    wy, wx = (F.broadcast(_axis_weights(voxels, axis, size, out)) for axis in ("y", "x"))
    weighted = voxels.join(wy, "y").join(wx, "x")
    total = F.sum(F.col(value) * F.col("_wy") * F.col("_wx"))
    return weighted.groupBy(*keys, F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(total.alias(value))


def resize_nearest(voxels: DataFrame, size: int, out: int) -> DataFrame:
    """Nearest resize: source index floor(i * size / out); each voxel is copied to the outputs that read it."""
    for axis in ("y", "x"):
        rows = [(o, o * size // out) for o in range(out)]
        table = F.broadcast(voxels.sparkSession.createDataFrame(rows, f"_o long, {axis} long"))
        voxels = voxels.join(table, axis).drop(axis).withColumnRenamed("_o", axis)
    return voxels


def chunk_columns(slice_index: Column, depth: int = CHUNK_DEPTH) -> tuple[Column, Column]:
    """Chunk number and depth inside the chunk."""
    return F.floor(slice_index / depth).cast("bigint"), F.pmod(slice_index, F.lit(depth)).cast("bigint")


def pad_depth(slices: DataFrame, key: str = "subject", multiple: int = CHUNK_DEPTH) -> DataFrame:
    """All slice rows of each volume and missing ones up to a multiple, with `padded` marking the latter."""
    sizes = slices.groupBy(key).agg((F.max("slice_index") + 1).alias("_n"))
    grid = sizes.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.ceil(F.col("_n") / multiple) * multiple - 1).cast("bigint"))).alias("slice_index"))
    return grid.join(slices.withColumn("_present", F.lit(True)), [key, "slice_index"], "left").withColumn("padded", F.col("_present").isNull()).drop("_present")


def require_whole_chunks(slices: DataFrame, key: str = "subject", depth: int = CHUNK_DEPTH) -> DataFrame:
    """Raise for volumes whose depth is no multiple of the chunk depth."""
    odd = slices.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % depth != 0).limit(5).collect()
    if odd:
        raise DataError(f"depth is no multiple of {depth}: {[(r[0], r['n']) for r in odd]}")
    return slices


def chunk_offsets(slices: DataFrame, key: str = "subject", depth: int = CHUNK_DEPTH) -> DataFrame:
    """Chunks of each volume and the number of chunks before it in key order: a row per volume, summed by buckets of the key."""
    counts = materialized(slices.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / depth).cast("bigint").alias("n_chunks")))
    ranked = ranked_by(counts.withColumn("_order", key_number(counts, key)), [], "_order", [F.col(key)], weight="n_chunks")
    return ranked.select(key, "n_chunks", F.col("_before").cast("bigint").alias("first_chunk"))


def locate_chunk(offsets: DataFrame, index: int, key: str = "subject") -> DataFrame:
    """The volume and chunk that a global chunk index names; no row when out of range."""
    inside = (F.col("first_chunk") <= index) & (F.col("first_chunk") + F.col("n_chunks") > index)
    return offsets.filter(inside).select(key, (F.lit(index) - F.col("first_chunk")).alias("chunk_index"))


def reassemble(chunks: DataFrame, key: str = "subject", depth: int = CHUNK_DEPTH) -> DataFrame:
    """Slice index of each row of chunks (chunk_index, z), in order along the depth."""
    return chunks.withColumn("slice_index", F.col("chunk_index") * depth + F.col("z"))


def with_extrema(voxels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    extrema = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return voxels.join(extrema, [*keys])


def quantize_levels(voxels: DataFrame, keys: Sequence[str], levels: int, value: str = "v") -> DataFrame:
    """Gray level q per voxel from its slice's range."""
    return with_extrema(voxels, keys, value).withColumn("q", scalar.quantize(F.col(value), F.col("_lo"), F.col("_hi"), levels)).drop("_lo", "_hi")


def normalize_slices(voxels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    return with_extrema(voxels, keys, value).withColumn("normed", scalar.normalize(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def loader_order(items: DataFrame, key: str, split: str, seed: int) -> DataFrame:
    """Items as an epoch reads them: training items in order of a seeded hash of the key, others by the key."""
    if split not in ("train", "val", "test"):
        raise ConfigError(f"split is train, val or test, not {split!r}")
    first = [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)] if split == "train" else []
    return items.orderBy(*first, key)
