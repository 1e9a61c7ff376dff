"""Contract checks: one aggregate each; what they find is a row, and raising is a separate step."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ConfigError, DataError, LeakageError


def range_counts(rows: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values below, above and NaN; NaN counts as a fault of its own."""
    v = F.col(value)
    nan = F.isnan(v)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((v < low) & ~nan).alias("n_below"), F.count_if((v > high) & ~nan).alias("n_above"), F.count_if(nan).alias("n_nan"),
        F.min(F.when(~nan, v)).alias("observed_min"), F.max(F.when(~nan, v)).alias("observed_max"),
    )


def require_range(rows: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    found = range_counts(rows, value, low, high).first()
    if found["n_below"] or found["n_above"] or found["n_nan"]:
        raise DataError(f"{value} must lie in [{low}, {high}]: observed {found['observed_min']} to {found['observed_max']}, {found['n_nan']} NaN")
    return rows


def non_binary_count(rows: DataFrame, value: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~value.isin(0, 1)).alias("n_non_binary"))


def require_shape(slices: DataFrame, key: str, depth_multiple: int, pixels: int, column: str) -> DataFrame:
    """Each volume's depth a multiple, each slice's array of the stated length."""
    per = slices.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi"))
    bad = per.filter((F.col("n") % depth_multiple != 0) | (F.col("lo") != pixels) | (F.col("hi") != pixels)).limit(1).collect()
    if bad:
        raise DataError(f"volume {bad[0][0]!r} has {bad[0]['n']} slices of {bad[0]['lo']} to {bad[0]['hi']} pixels; wanted a multiple of {depth_multiple} of {pixels}")
    return slices


def split_leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Training keys that also are test keys."""
    return train.select(key).distinct().join(test.select(key), key, "left_semi")


def require_no_leakage(train: DataFrame, test: DataFrame, key: str) -> None:
    found = split_leakage(train, test, key).limit(5).collect()
    if found:
        raise LeakageError(f"training uses test subjects: {[r[0] for r in found]}")


def require_binary(rows: DataFrame, value: Column) -> DataFrame:
    found = non_binary_count(rows, value).first()
    if found["n_non_binary"]:
        raise DataError(f"{found['n_non_binary']} of {found['n']} values are neither 0 nor 1")
    return rows


def require_equal_shapes(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> None:
    """Both sides hold the same keys as often, with arrays of the same lengths; nothing is broadcast."""
    per = lambda side, name: side.groupBy(*keys).agg(F.sort_array(F.collect_set(F.size(column))).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
    joined = per(left, "_l").join(per(right, "_r"), list(keys), "full_outer")
    bad = joined.filter(~F.col("_l").eqNullSafe(F.col("_r")) | ~F.col("_l_n").eqNullSafe(F.col("_r_n"))).limit(1).collect()
    if bad:
        raise DataError(f"shapes differ at {tuple(bad[0][k] for k in keys)}: {bad[0]['_l']} and {bad[0]['_r']}")


def require_renderable(slices: DataFrame, keys: Sequence[str], columns: Sequence[str], key: str, volume: object, depth: int) -> DataFrame:
    """The slice (volume, depth), if it is there once and every one of the array columns is finite there.

    A picture of NaN or of an infinite value looks plausible, so it is refused; a depth outside the
    volume is told with the volume's depth.
    """
    own = slices.filter(F.col(key).eqNullSafe(F.lit(volume)))
    found = own.filter(F.col("slice_index") == depth).select(*keys, *columns)
    bad = lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = found.select(*(F.coalesce(bad(c), F.lit(True)).alias(c) for c in columns)).limit(2).collect()
    if len(rows) != 1:
        raise DataError(f"depth {depth} of volume {volume!r} occurs {len(rows)} times; it has {own.count()} slices")
    broken = [c for c in columns if rows[0][c]]
    if broken:
        raise DataError(f"volume {volume!r} at depth {depth}: {broken} hold values that are not finite")
    return found


def require_stored(results: object, caller: str) -> str:
    """The path of stored results; a model or a frame in its place is an error, as scoring never runs a model again."""
    if not isinstance(results, str | os.PathLike):
        raise ConfigError(f"{caller} reads stored results from a path, not from a {type(results).__name__}")
    return os.fspath(results)


#: The settings that a study's configuration may take.
CHOICES = {
    "donor_alignment": ("same", "random"),
    "donor_chunk": ("same", "random"),
    "selection_mode": ("min", "max"),
    "selection_key": ("val_loss", "val_dice"),
    "residual_scale": ("per_volume", "per_slice"),
}
#: Settings of which a configuration may name one at most, and settings that another one needs.
EXCLUSIVE = (("warm_start_from", "init_from"),)
NEEDS = ((("selection_key", "val_dice"), "validate_fn"),)


def require_settings(settings: Mapping[str, object]) -> Mapping[str, object]:
    """The settings, if each known one takes an allowed value, exclusive ones do not meet, and what one needs is there.

    All faults are told at once. Settings that no rule names are left alone.
    """
    faults = [f"{name} is one of {allowed}, not {settings[name]!r}" for name, allowed in CHOICES.items() if name in settings and settings[name] not in allowed]
    faults += [f"{' and '.join(names)} exclude each other" for names in EXCLUSIVE if sum(bool(settings.get(n)) for n in names) > 1]
    faults += [f"{name}={value!r} needs {other}" for (name, value), other in NEEDS if settings.get(name) == value and settings.get(other) is None]
    if faults:
        raise ConfigError("; ".join(faults))
    return settings


def frame_size(width: float, height: float, dpi: int) -> tuple[int, int]:
    """Pixels of a figure in inches; both must be whole and even, as a video's frames are."""
    pixels = width * dpi, height * dpi
    if any(abs(p - round(p)) > 1e-6 or round(p) % 2 or round(p) <= 0 for p in pixels):
        raise ConfigError(f"a frame of {width} by {height} inches at {dpi} dpi has {pixels} pixels, not even whole numbers")
    return round(pixels[0]), round(pixels[1])


def require_size(slices: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """The slices, if there are any and all have that height and width; the first volume that differs is told."""
    seen = slices.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(key, "height", "width"), F.when((F.col("height") != height) | (F.col("width") != width), F.col(key).cast("string"))).alias("other")).first()
    if not seen["n"]:
        raise DataError("no slices: every one was left out, or none was read")
    if seen["other"] is not None:
        raise DataError(f"volume {seen['other'][0]!r} has slices of {seen['other']['height']} by {seen['other']['width']}, wanted {height} by {width}")
    return slices
