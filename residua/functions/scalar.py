"""Scalar expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Rounded to six places, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def residual(original: Column, reconstruction: Column) -> Column:
    return F.abs(original - reconstruction)


def quantize(v: Column, lowest: Column, highest: Column, levels: int) -> Column:
    """Gray level by half-even rounding of the min-max scaled value; constant input gives 0."""
    scaled = F.try_divide(v - lowest, highest - lowest)
    return F.coalesce(F.rint(scaled * (levels - 1)), F.lit(0.0)).cast("bigint")


def normalize(v: Column, lowest: Column, highest: Column, eps: float = 1e-8) -> Column:
    """Clipped min-max scaling; a degenerate or non-finite range gives 0."""
    bad = F.isnan(lowest) | F.isnan(highest) | (F.abs(lowest) == float("inf")) | (F.abs(highest) == float("inf")) | (highest - lowest <= eps)
    scaled = F.try_divide(v - lowest, highest - lowest)
    return F.when(bad | scaled.isNull(), 0.0).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def gray_byte(v: Column) -> Column:
    """A [0, 1] value as a 0-255 level, truncated."""
    return F.floor(v * 255).cast("bigint")


def overlay(base: Column, hit: Column, tint: int = 255, alpha: float = 0.45) -> Column:
    """Blend a tint onto a 0-255 level where hit, truncated and clipped."""
    blended = F.when(hit, (1 - alpha) * base + alpha * tint).otherwise(base.cast("double"))
    return F.floor(F.least(F.greatest(blended, F.lit(0.0)), F.lit(255.0))).cast("bigint")


def rescale_signed(v: Column) -> Column:
    """[0, 1] to [-1, 1], clamped."""
    return F.least(F.greatest(v * 2 - 1, F.lit(-1.0)), F.lit(1.0))


def rescale_unit(v: Column) -> Column:
    """[-1, 1] to [0, 1], clamped."""
    return F.least(F.greatest((v + 1) / 2, F.lit(0.0)), F.lit(1.0))


def cell_id(model: Column, loss: Column) -> Column:
    return F.concat_ws("__", model, loss)


def render_na(value: Column, reason: Column, places: int = 4) -> Column:
    """A number rounded by its exact binary value, as `%.4f` is in C, else `n/a (reason)`."""
    shown = F.call_function("format_number", value, F.lit("0." + "0" * places))
    return F.when(value.isNotNull(), shown).otherwise(F.concat(F.lit("n/a ("), reason, F.lit(")")))


def dotted_get(document: Column, path: str) -> Column:
    """A value of a JSON string by dotted path; null where it is missing."""
    return F.get_json_object(document, f"$.{path}")


def blake_seed(seed: int, epoch: int, index: int) -> int:
    """A non-negative 63-bit seed per item, the same for any number of workers."""
    digest = hashlib.blake2b(f"{seed}:{epoch}:{index}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") & ((1 << 63) - 1)


def item_seed(seed: Column, epoch: Column, index: Column) -> Column:
    """A 63-bit seed per item inside the JVM; it differs from blake_seed, which no SQL function gives."""
    return F.xxhash64(F.concat_ws(":", seed, epoch, index)).bitwiseAND(F.lit((1 << 63) - 1))


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) that depends on the parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def canonical_hash(document: object) -> str:
    """SHA-256 of a document as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()


def timesteps(t_noise: int, n_steps: int, n_train: int) -> list[int]:
    """Descending steps that begin at t_noise, then the strided grid below it."""
    stride = max(1, n_train // n_steps)
    return [t_noise, *(t for t in range((n_train - 1) // stride * stride, -1, -stride) if t < t_noise)]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it several times in body, also inside lambdas, where Catalyst would evaluate it per element."""
    return F.transform(F.array(value), body)[0]
