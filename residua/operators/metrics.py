"""Overlap and fidelity metrics, each defined once as an expression over sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ConfigError, MSE_FLOOR, OVERLAP_EPS, DataError


def dice_of(both: Column, predicted: Column, truth: Column) -> Column:
    """2 |P and G| / (|P| + |G| + eps); exactly 1 when both are empty."""
    return F.when(predicted + truth == 0, 1.0).otherwise(2.0 * both / (predicted + truth + OVERLAP_EPS))


def iou_of(both: Column, predicted: Column, truth: Column) -> Column:
    union = predicted + truth - both
    return F.when(union == 0, 1.0).otherwise(both / (union + OVERLAP_EPS))


def overlap(voxels: DataFrame, keys: Sequence[str], predicted: Column, truth: Column) -> DataFrame:
    """dice and iou per key. Mask and truth stand in one row, so there is no voxel join."""
    sums = voxels.groupBy(*keys).agg(F.count_if(predicted & truth).alias("_i"), F.count_if(predicted).alias("_p"), F.count_if(truth).alias("_g"))
    i, p, g = F.col("_i"), F.col("_p"), F.col("_g")
    return sums.select(*keys, dice_of(i, p, g).alias("dice"), iou_of(i, p, g).alias("iou"))


def psnr(voxels: DataFrame, keys: Sequence[str], original: str, reconstruction: str) -> DataFrame:
    """10 log10(1 / max(mse, floor)) per key."""
    mse = F.avg(F.pow(F.col(original) - F.col(reconstruction), 2))
    return voxels.groupBy(*keys).agg((10 * F.log10(1 / F.greatest(mse, F.lit(MSE_FLOOR)))).alias("psnr_db"))


def overlap_bugcompat(voxels: DataFrame, keys: Sequence[str], predicted: Column, raw: Column) -> DataFrame:
    """The former formulas: raw labels in the sums, no guard; 0 / 0 is null (NaN there)."""
    p = predicted.cast("double")
    sums = voxels.groupBy(*keys).agg(F.sum(p * raw).alias("_i"), F.sum(p).alias("_p"), F.sum(raw.cast("double")).alias("_g"))
    i, total = F.col("_i"), F.col("_p") + F.col("_g")
    return sums.select(*keys, F.try_divide(2 * i, total).alias("dice"), F.try_divide(i, total - i).alias("iou"))


def aggregate_metrics(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, and mean and population deviation of each column. No rows is an error when the frame is used."""
    parts = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    total = scores.agg(F.count(F.lit(1)).alias("n"), *parts)
    checked = F.when(F.col("n") == 0, F.raise_error(F.lit("no volumes to aggregate")).cast("bigint")).otherwise(F.col("n"))
    return total.withColumn("n", checked)


def legacy_last_only(scores: DataFrame, key: str, column: str = "dice") -> DataFrame:
    """The former 'average': the score of the last subject only."""
    return scores.agg(F.max(key).alias("last_subject"), F.max_by(column, key).alias("reported"), F.avg(column).alias("true_mean"))


def _gaussian(window: int, sigma: float) -> np.ndarray:
    x = np.arange(window) - (window - 1) / 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def _blur(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    for axis in range(a.ndim):
        a = np.lib.stride_tricks.sliding_window_view(a, len(kernel), axis) @ kernel
    return a


def ssim_map(x: np.ndarray, y: np.ndarray, window: int = 11, sigma: float = 1.5, data_range: float = 1.0) -> np.ndarray:
    """Structural similarity at each place of a Gaussian window that lies inside, in as many dimensions as x has."""
    k = _gaussian(window, sigma)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    mx, my = _blur(x, k), _blur(y, k)
    vx, vy, vxy = _blur(x * x, k) - mx**2, _blur(y * y, k) - my**2, _blur(x * y, k) - mx * my
    return ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))


def ssim_value(x: np.ndarray, y: np.ndarray, window: int = 11, sigma: float = 1.5, data_range: float = 1.0) -> float:
    """The mean of that map; every dimension must reach the window."""
    if min(x.shape) < window:
        raise DataError(f"every dimension must reach the window {window}, not {x.shape}")
    return float(ssim_map(x, y, window, sigma, data_range).mean())


def ssim(slices: DataFrame, key: str, height: int, width: int, original: str = "original", reconstruction: str = "reconstruction", window: int = 11, slab: int = 64) -> DataFrame:
    """SSIM per volume from slice rows, indexed gapless from 0; a volume below the window in depth fails when it is read.

    A group is a slab of `slab` window places with the window - 1 slices beyond it, so memory does not grow with the depth.
    """
    if min(height, width) < window:
        raise DataError(f"slices of {height} by {width} do not reach the window {window}")

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("slice_index")
        if len(group) < window:
            return pd.DataFrame({key: [group[key].iloc[0]], "_total": [0.0], "_n": [0]})
        x, y = (np.stack([np.asarray(r, float) for r in group[c]]).reshape(-1, height, width) for c in (original, reconstruction))
        found = ssim_map(x, y, window)
        return pd.DataFrame({key: [group[key].iloc[0]], "_total": [found.sum()], "_n": [found.size]})

    first = F.greatest(F.floor((F.col("slice_index") - (window - 1)) / slab), F.lit(0))
    slabs = F.explode(F.sequence(first, F.floor(F.col("slice_index") / slab)))
    kind = slices.schema[key].dataType.simpleString()
    parts = slices.select(key, "slice_index", original, reconstruction, slabs.alias("_slab")).groupBy(key, "_slab").applyInPandas(score, f"{key} {kind}, _total double, _n bigint")
    total, n = F.sum("_total"), F.sum("_n")
    return parts.groupBy(key).agg(F.when(n == 0, F.raise_error(F.lit(f"a volume has fewer slices than the window {window}")).cast("double")).otherwise(total / n).alias("ssim"))


def mse_loss(voxels: DataFrame, keys: Sequence[str], original: str, reconstruction: str) -> DataFrame:
    return voxels.groupBy(*keys).agg(F.avg(F.pow(F.col(original) - F.col(reconstruction), 2)).alias("mse"))


def block_mean(voxels: DataFrame, keys: Sequence[str], columns: Sequence[str], scale: int) -> DataFrame:
    """Downscale slices by 2 or 4 as trilinear interpolation does: the mean of the two central samples per axis."""
    if scale not in (2, 4):
        raise DataError(f"scale must be 2 or 4, not {scale}")
    if scale == 4:
        voxels = voxels.filter(F.pmod("y", F.lit(4)).isin(1, 2) & F.pmod("x", F.lit(4)).isin(1, 2))
    cell = [F.floor(F.col(a) / scale).alias(f"_{a}") for a in ("y", "x")]
    return voxels.groupBy(*keys, *cell).agg(*(F.avg(c).alias(c) for c in columns))


def multiscale_mse(voxels: DataFrame, key: str, keys: Sequence[str], original: str, reconstruction: str) -> DataFrame:
    """The mean of the MSEs at full, half and quarter size, per volume."""
    parts = []
    for scale in (1, 2, 4):
        frame = voxels if scale == 1 else block_mean(voxels, keys, [original, reconstruction], scale)
        parts.append(mse_loss(frame, [key], original, reconstruction))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy(key).agg(F.avg("mse").alias("multiscale_mse"))


def ssim_mse_loss(mse: Column, ssim_score: Column, alpha: float = 0.5) -> Column:
    """alpha (1 - SSIM) + (1 - alpha) MSE; null where either is."""
    if not 0 <= alpha <= 1:
        raise ConfigError(f"alpha lies in [0, 1], not {alpha}")
    return alpha * (1 - ssim_score) + (1 - alpha) * mse


def ssim_mse_by_slice(slices: DataFrame, keys: Sequence[str], height: int, width: int, original: str = "original", reconstruction: str = "reconstruction", window: int = 11, alpha: float = 0.5) -> DataFrame:
    """keys, mse, ssim and loss of each slice row: the weighted loss of 2-D SSIM and MSE, without a shuffle."""
    kinds = ", ".join(f"{k} {slices.schema[k].dataType.simpleString()}" for k in keys)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(batch["_a"], batch["_b"], strict=True)]
            out = batch[list(keys)].copy()
            out["mse"] = [float(((a - b) ** 2).mean()) for a, b in pairs]
            out["ssim"] = [ssim_value(a.reshape(height, width), b.reshape(height, width), window) for a, b in pairs]
            yield out

    scored = slices.select(*keys, F.col(original).alias("_a"), F.col(reconstruction).alias("_b")).mapInPandas(score, f"{kinds}, mse double, ssim double")
    return scored.withColumn("loss", ssim_mse_loss(F.col("mse"), F.col("ssim"), alpha))


def ssim_arrow(batches: Iterator[pd.DataFrame], height: int, width: int, window: int) -> Iterator[pd.DataFrame]:
    """2-D SSIM per slice row, without a shuffle."""
    for batch in batches:
        values = [ssim_value(np.asarray(a, float).reshape(height, width), np.asarray(b, float).reshape(height, width), window) for a, b in zip(batch["original"], batch["reconstruction"], strict=True)]
        yield pd.DataFrame({"subject": batch["subject"], "slice_index": batch["slice_index"], "ssim": values})
