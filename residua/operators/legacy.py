"""The former evaluation, faults included, so that its numbers can be told from the corrected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, preprocess


def crop_starts(size: int, crop: int) -> int:
    return (size - crop) // 2


def preprocess_legacy(voxels: DataFrame, key: str, height: int, width: int, crop: int, chunk: int = 4, depth: int = 16) -> DataFrame:
    """Min-max without a guard, centre crop of height and width only, and one chunk."""
    scaled = preprocess.minmax_volume(voxels, key, eps=0.0)
    y0, x0 = crop_starts(height, crop), crop_starts(width, crop)
    cropped = preprocess.crop_box(scaled, {"y": (y0, y0 + crop), "x": (x0, x0 + crop)})
    return cropped.filter((F.col("slice_index") >= chunk * depth) & (F.col("slice_index") < (chunk + 1) * depth))


def evaluate_legacy(voxels: DataFrame, key: str, output: str, raw_label: str, cut: float = 0.1) -> DataFrame:
    """Scores of the rescaled output's excess over the cut, with raw labels; then read only the last subject's."""
    rescaled = preprocess.minmax_volume(voxels, key, output, eps=0.0, out="_rescaled")
    return metrics.overlap_bugcompat(rescaled, [key], F.coalesce(F.col("_rescaled") > cut, F.lit(False)), F.col(raw_label))
