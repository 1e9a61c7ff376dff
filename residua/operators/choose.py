"""Operators named by configuration: {target, params}, as a study's configuration files hold them."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import ConfigError
from . import thresholds


def percentile(voxels: DataFrame, key: str, flat_index: str, percentile: float, residual: str = "residual") -> DataFrame:
    return thresholds.percentile_mask(voxels, key, flat_index, percentile, residual)


def absolute(voxels: DataFrame, key: str, flat_index: str, value: float, residual: str = "residual") -> DataFrame:
    return voxels.withColumn("flagged", F.coalesce(thresholds.absolute_mask(F.col(residual), value), F.lit(False)))


def otsu(voxels: DataFrame, key: str, flat_index: str, bins: int = 256, residual: str = "residual") -> DataFrame:
    return thresholds.otsu_mask(voxels, key, bins, residual)


#: What a threshold's target may name, and the parameters that are not its own.
THRESHOLDS: dict[str, Callable[..., DataFrame]] = {"percentile": percentile, "absolute": absolute, "otsu": otsu}
GIVEN = ("voxels", "key", "flat_index", "residual")


def from_config(node: Mapping[str, object], targets: Mapping[str, Callable[..., DataFrame]] | None = None) -> Callable[..., DataFrame]:
    """The operator that a node {target, params} names, with its parameters bound; to be called with a frame and its columns.

    Targets are looked up in `targets` and never imported, so a configuration cannot run other code.
    An unknown target, and missing and unknown parameters, are errors here, not when data are read.
    """
    targets = THRESHOLDS if targets is None else targets
    unknown = sorted(node.keys() - {"target", "params"})
    if unknown or node.get("target") not in targets:
        raise ConfigError(f"no such target: {node.get('target')!r}, {unknown}; there are {sorted(targets)}")
    chosen, params = targets[node["target"]], dict(node.get("params") or {})
    own = {name: p for name, p in inspect.signature(chosen).parameters.items() if name not in GIVEN}
    missing = sorted(name for name, p in own.items() if p.default is p.empty and name not in params)
    strange = sorted(params.keys() - own.keys())
    if missing or strange:
        raise ConfigError(f"{node['target']} lacks {missing} and does not take {strange}")
    return lambda rows, key, flat_index, residual="residual": chosen(rows, key, flat_index, residual=residual, **params)
