"""Stored results: tables with fixed schemas, manifests and run documents. Malformed input raises; absence does not."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import SPLIT, ArtifactError
from ..operators.validate import require_stored
from .committed import load_version, save_version
from .volumes import volume_files


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of the schema; another header and an empty table are errors here, a malformed value when it is read."""
    wanted = spark.createDataFrame([], schema).columns
    header = spark.read.option("header", True).csv(path).columns
    if header != wanted:
        raise ArtifactError(f"{path} has columns {header}, wanted {wanted}")
    frame = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if frame.isEmpty():
        raise ArtifactError(f"no rows in {path}")
    return frame


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document of the schema, None where there is no file; malformed documents are errors."""
    try:
        frame = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        frame.isEmpty()
    except AnalysisException:
        return None
    except Exception as error:
        raise ArtifactError(f"malformed document {path}: {error}") from error
    return frame


def newest_run(spark: SparkSession, root: str, glob: str = "part-*", run_id: str | None = None) -> str:
    """The named run, else the one below root whose newest file of the pattern is newest; of equal times the greater name.

    Runs are folders of root, with or without `run_id=`. A run that holds no such file (no checkpoint, no
    result) is no run: naming it, and having none, are errors. Files are listed, not read.
    """
    if run_id is not None:
        root = next((p for p in (f"{root}/run_id={run_id}", f"{root}/{run_id}") if _has_files(spark, p, glob)), None)
        if root is None:
            raise ArtifactError(f"run {run_id} holds no {glob}")
        return run_id
    top = re.escape(root.rstrip("/").rsplit("/", 1)[-1])
    try:
        files = volume_files(spark, root, glob)
    except AnalysisException as error:
        raise ArtifactError(f"no runs at {root}") from error
    runs = files.select(F.regexp_extract("path", f"/{top}/(?:run_id=)?([^/]+)/", 1).alias("run"), F.col("modificationTime").alias("at")).filter("run <> ''")
    found = runs.agg(F.max_by("run", F.struct("at", "run"))).first()[0]
    if found is None:
        raise ArtifactError(f"no run at {root} holds a {glob}")
    return found


def _has_files(spark: SparkSession, path: str, glob: str) -> bool:
    try:
        return not volume_files(spark, path, glob).isEmpty()
    except AnalysisException:
        return False


def read_results(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Slice rows of one run, the newest where none is named; other runs' partitions are pruned."""
    root = require_stored(root, "read_results")
    return spark.read.parquet(root).filter(F.col("run_id") == newest_run(spark, root, run_id=run_id))


def point_lookup(results: DataFrame, volume_id: str) -> DataFrame:
    """One volume; a miss tells how many volumes there are, not which."""
    found = results.filter(F.col("volume_id") == volume_id)
    if found.isEmpty():
        raise ArtifactError(f"volume is not among {results.select('volume_id').distinct().count()} stored ones")
    return found


def require_manifest(manifest: DataFrame, **expected: str) -> DataFrame:
    """The manifest if its fields are as expected and split_hash is there; else an error that names the field."""
    row = manifest.first()
    if row is None:
        raise ArtifactError("manifest is empty")
    fields = row.asDict()
    for name, value in expected.items():
        if fields.get(name) != value:
            raise ArtifactError(f"manifest field {name} is {fields.get(name)!r}, wanted {value!r}")
    if not fields.get("split_hash"):
        raise ArtifactError("manifest has no split_hash")
    return manifest


def feature_key(granularity: str, split_hash: str, seed: int, feature_names: Sequence[str], **shaping: object) -> dict[str, str]:
    """The key of a feature cache: where the rows come from and every parameter that shapes them.

    `shaping` must name them all, such as the limit of subjects, the label threshold and whether empty
    slices are left out: two runs that differ in one of them never share a cache.
    """
    missing = sorted({"subject_limit", "drop_empty_slices", "label_threshold_voxels"} - shaping.keys())
    if missing:
        raise ArtifactError(f"the key of a feature cache lacks {missing}")
    fields = {"granularity": granularity, "split_hash": split_hash, "seed": seed, "feature_names": list(feature_names)} | shaping
    return {name: json.dumps(value, sort_keys=True) for name, value in fields.items()}


def feature_cache(spark: SparkSession, path: str, key: dict[str, str]) -> DataFrame | None:
    """Cached features if the stored key matches in every field; None when absent, an error when it differs."""
    return load_version(spark, path, key)


def save_feature_cache(features: DataFrame, path: str, key: dict[str, str]) -> None:
    """A new version of the cache; the old one stays in force, features and key together, until the new one is whole."""
    save_version(features, path, key)


def load_split(spark: SparkSession, path: str) -> tuple[int, dict[str, dict[str, list[str]]]]:
    """The seed and the parts of a saved split; a missing or empty file is an error."""
    found = read_json(spark, path, SPLIT)
    row = found.first() if found is not None else None
    if row is None or row["seed"] is None:
        raise ArtifactError(f"no split at {path}")
    return row["seed"], row["parts"]
