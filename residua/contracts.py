"""Constants, schemas and errors that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

#: Voxels of a preprocessed volume (channel, depth, height, width) and the numeric guards.
VOLUME_SHAPE = (1, 16, 128, 128)
CHUNK_DEPTH = 16
OVERLAP_EPS = 1e-6
RANGE_EPS = 1e-8
MSE_FLOOR = 1e-6


class ResiduaError(Exception):
    """Base of all errors of this package."""


class DataError(ResiduaError):
    """Input data break their contract."""


class ConfigError(ResiduaError):
    """A parameter is out of range or excluded by another."""


class ArtifactError(ResiduaError):
    """A stored result is missing, malformed or belongs to another run."""


class LeakageError(ResiduaError):
    """Test subjects occur where only training subjects may."""


class SplitError(ResiduaError):
    """A split differs from the recorded one."""


VOLUME = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("volume_id", T.StringType()),
        T.StructField("slice_index", T.LongType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("original", T.ArrayType(T.FloatType())),
        T.StructField("reconstruction", T.ArrayType(T.FloatType())),
        T.StructField("mask", T.ArrayType(T.ByteType())),
        T.StructField("ground_truth", T.ArrayType(T.ByteType())),
    ]
)
SLICE_SCORE = "volume_id string, slice_index bigint, flagged_voxels bigint, n_voxels bigint, flagged_fraction double, foreground_fraction double, label bigint"
OOF_PREDICTION = "granularity string, fold bigint, volume_id string, slice_index bigint, y_true bigint, y_score double"
VOLUME_METRICS = "volume_id string, dice double, iou double, psnr_db double, ssim double"
MANIFEST = "model string, loss string, split string, n_volumes bigint, split_hash string"
SPLIT = "seed bigint, parts map<string, map<string, array<string>>>"
