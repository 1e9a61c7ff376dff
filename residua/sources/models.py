"""Fitted models in versions, with the provenance that they were saved with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..contracts import ArtifactError
from .committed import current, load_version, read_file, save_version, write_text
from .volumes import is_lfs_stub

#: What a saved model must tell about its making.
PROVENANCE = ("epoch", "selection_key", "selection_value", "val_loss", "git_sha", "seed", "split_hash", "synth", "train")
POINTER = "MODEL"


def _checked(provenance: Mapping[str, object]) -> dict[str, object]:
    differing = sorted(set(PROVENANCE) ^ provenance.keys())
    if differing:
        raise ArtifactError(f"provenance lacks or adds {differing}")
    return dict(provenance)


def kind_of(model: object) -> str:
    kind = model if isinstance(model, type) else type(model)
    return f"{kind.__module__}.{kind.__qualname__}"


def save_model(model: MLWritable, path: str, provenance: Mapping[str, object]) -> str:
    """Write a fitted model as a new version, then make it the current one; its name. Provenance holds all of PROVENANCE."""
    told, version = _checked(provenance), uuid.uuid4().hex
    model.write().save(f"{path}/versions/{version}")
    write_text(f"{path}/{POINTER}", json.dumps({"version": version, "kind": kind_of(model), "provenance": told}, indent=2, sort_keys=True) + "\n")
    return version


def model_record(path: str) -> dict:
    """version, kind and provenance of the current model; missing, stub and foreign files are errors."""
    content = read_file(f"{path}/{POINTER}")
    if content is None:
        raise ArtifactError(f"no model at {path}")
    if is_lfs_stub(content):
        raise ArtifactError(f"the model at {path} is a pointer stub of {len(content)} bytes, not the model")
    try:
        found = json.loads(content)
        record = {name: found[name] for name in ("version", "kind", "provenance")}
    except (ValueError, KeyError, TypeError) as error:
        raise ArtifactError(f"foreign file as the model at {path}: {error!r}") from error
    _checked(record["provenance"])
    return record


def require_provenance(found: Mapping[str, object], expected: Mapping[str, object], path: str) -> None:
    for name, value in expected.items():
        if found.get(name) != value:
            raise ArtifactError(f"model at {path} differs in {name}: {found.get(name)!r}, wanted {value!r}")


def load_model(kind: type[MLReadable], path: str, **expected: object) -> tuple[MLReadable, dict[str, object]]:
    """The current model of this class and its provenance, which must hold what is expected of it."""
    record = model_record(path)
    if record["kind"] != kind_of(kind):
        raise ArtifactError(f"model at {path} is a {record['kind']}, wanted {kind_of(kind)}")
    require_provenance(record["provenance"], expected, path)
    try:
        return kind.load(f"{path}/versions/{record['version']}"), record["provenance"]
    except Exception as error:
        raise ArtifactError(f"model at {path} cannot be read: {error}") from error


def save_components(spark: SparkSession, mean: np.ndarray, components: np.ndarray, path: str, provenance: Mapping[str, object]) -> str:
    """Mean and components, a row per pixel, as a new version."""
    if components.ndim != 2 or mean.shape != components.shape[:1]:
        raise ArtifactError(f"a mean of {mean.shape} does not fit components of {components.shape}")
    key = {name: json.dumps(value, sort_keys=True) for name, value in _checked(provenance).items()}
    rows = [(i, float(m), row.tolist()) for i, (m, row) in enumerate(zip(mean, components, strict=True))]
    return save_version(spark.createDataFrame(rows, "pixel bigint, mean double, loadings array<double>"), path, key)


def load_components(spark: SparkSession, path: str, pixels: int | None = None, k: int | None = None, **expected: object) -> tuple[np.ndarray, np.ndarray, dict[str, object]]:
    """Mean, components and provenance; a shape other than the wanted one, gaps and other columns are errors."""
    found = current(path)
    rows = load_version(spark, path) if found else None
    if rows is None:
        raise ArtifactError(f"no components at {path}")
    told = {name: json.loads(value) for name, value in found["key"].items()}
    require_provenance(_checked(told), expected, path)
    try:
        held = rows.select("pixel", F.col("mean").cast("double"), F.col("loadings").cast("array<double>")).orderBy("pixel").toArrow()
    except AnalysisException as error:
        raise ArtifactError(f"foreign table as components at {path}") from error
    sizes = set(map(len, held["loadings"].to_pylist()))
    if held["pixel"].to_pylist() != list(range(held.num_rows)) or len(sizes) != 1:
        raise ArtifactError(f"components at {path} have gaps")
    mean, components = held["mean"].to_numpy(), np.array(held["loadings"].to_pylist())
    if components.shape != (pixels or components.shape[0], k or components.shape[1]):
        raise ArtifactError(f"components at {path} are {components.shape}, wanted {(pixels, k)}")
    return mean, components, told
