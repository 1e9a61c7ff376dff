"""Volume files as slice rows."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import DataError

SLICE_ROWS = "volume_id string, slice_index bigint, height int, width int, pixels array<float>"
#: NumPy types of the NIfTI-1 codes for integers and floats.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def parse_npy(content: bytes) -> np.ndarray:
    """(depth, height, width) of a .npy file; leading axes of length one are dropped."""
    array = np.load(io.BytesIO(content), allow_pickle=False)
    while array.ndim > 3 and array.shape[0] == 1:
        array = array[0]
    if array.ndim != 3:
        raise DataError(f"a volume has three axes, not {array.shape}")
    return array.astype(np.float32)


def nifti_header(content: bytes) -> tuple[tuple[int, ...], np.dtype, int, float, float]:
    """Shape, type, data offset, slope and intercept of a NIfTI-1 file."""
    for order in "<>":
        if np.frombuffer(content, f"{order}i4", 1)[0] == 348:
            break
    else:
        raise DataError("not a NIfTI-1 header")
    dims = np.frombuffer(content, f"{order}i2", 8, 40)
    code = int(np.frombuffer(content, f"{order}i2", 1, 70)[0])
    if code not in NIFTI_TYPES:
        raise DataError(f"NIfTI type {code} is not read")
    offset, slope, intercept = (float(np.frombuffer(content, f"{order}f4", 1, at)[0]) for at in (108, 112, 116))
    return tuple(int(d) for d in dims[1 : dims[0] + 1]), np.dtype(order + NIFTI_TYPES[code]), int(offset), slope, intercept


def parse_nifti(content: bytes) -> np.ndarray:
    """(depth, height, width) of a .nii or .nii.gz file stored as (height, width, depth), scaled as its header says."""
    content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    shape, kind, offset, slope, intercept = nifti_header(content)
    while len(shape) > 3 and shape[-1] == 1:
        shape = shape[:-1]
    if len(shape) != 3:
        raise DataError(f"a volume has three axes, not {shape}")
    array = np.frombuffer(content, kind, int(np.prod(shape)), offset).reshape(shape, order="F").astype(np.float32)
    if slope not in (0.0, 1.0) or intercept and slope:
        array = array * np.float32(slope) + np.float32(intercept)
    return np.transpose(array, (2, 0, 1))


def volumes_as_npy(slices: DataFrame, key: str, height: int, width: int, pixels: str = "pixels") -> DataFrame:
    """(name, content) of a .npy file per volume from its slice rows, to be written by `save_files`. A volume is one task's group.

    Slices stand in order of slice_index; one of another size raises.
    """

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("slice_index")
        rows = group["_pixels"].to_pylist()
        if any(len(r) != height * width for r in rows):
            raise DataError(f"a slice of {group['_key'][0]} has no {height} by {width} pixels")
        out = io.BytesIO()
        np.save(out, np.array(rows, np.float32).reshape(len(rows), height, width))
        return pa.table({"name": [f"{group['_key'][0].as_py()}.npy"], "content": pa.array([out.getvalue()], pa.binary())})

    named = slices.select(F.col(key).cast("string").alias("_key"), F.col("slice_index").cast("bigint").alias("slice_index"), F.col(pixels).cast("array<float>").alias("_pixels"))
    return named.groupBy("_key").applyInArrow(pack, "name string, content binary")


def volume_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, modificationTime and length of matching files, recursively; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).drop("content")


def read_volumes(spark: SparkSession, root: str, glob: str = "*.npy") -> DataFrame:
    """Slice rows of .npy or NIfTI files; volume_id is the file's name without its suffix. A file is one task's row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    named = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(npy|nii\.gz|nii)$", "").alias("volume_id"), "path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, path, content = (batch.column(c)[i].as_py() for c in range(3))
                volume = parse_npy(content) if path.endswith(".npy") else parse_nifti(content)
                d, h, w = volume.shape
                rows = [pa.array([name] * d), pa.array(range(d), pa.int64()), pa.array([h] * d, pa.int32()), pa.array([w] * d, pa.int32()), pa.array(list(volume.reshape(d, -1)), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(rows, ["volume_id", "slice_index", "height", "width", "pixels"])

    return named.mapInArrow(parse, SLICE_ROWS)


def resolve_modality(files: DataFrame, modality: str) -> DataFrame:
    """(subject, path): the .nii.gz file of a modality, else the .nii file; subjects without either have a null path."""
    parts = F.split("path", "/")
    named = files.select("path", F.element_at(parts, -2).alias("subject"), F.element_at(parts, -1).alias("_name"))
    rank = F.when(F.col("_name").endswith(f"_{modality}.nii.gz"), 0).when(F.col("_name").endswith(f"_{modality}.nii"), 1)
    return named.groupBy("subject").agg(F.min_by("path", rank).alias("path"))


def require_modality(resolved: DataFrame) -> DataFrame:
    missing = resolved.filter("path is null").count()
    if missing:
        raise DataError(f"{missing} subjects lack the modality")
    return resolved


def is_lfs_stub(content: bytes) -> bool:
    """Whether a checkpoint is only a pointer that large-file storage left behind."""
    return content.startswith(b"version https://git-lfs.github.com/spec/")


def presence_audit(spark: SparkSession, root: str, required: Sequence[tuple[str, str]]) -> DataFrame:
    """folder, pattern, n_files, state (ok, empty or missing) of each required pair, from listings alone."""
    found = []
    for folder, pattern in required:
        try:
            found.append((folder, pattern, volume_files(spark, f"{root}/{folder}", pattern).count()))
        except AnalysisException:
            found.append((folder, pattern, None))
    state = F.when(F.col("n_files").isNull(), "missing").when(F.col("n_files") == 0, "empty").otherwise("ok")
    return spark.createDataFrame(found, "folder string, pattern string, n_files bigint").withColumn("state", state)


def require_present(audit: DataFrame) -> None:
    """Raise with every folder that is missing or empty."""
    bad = audit.filter("state <> 'ok'").collect()
    if bad:
        raise DataError("; ".join(f"{r['folder']}/{r['pattern']} is {r['state']}" for r in bad))


def relative_path(path: Column, root: str) -> Column:
    """The path below root; other paths as they are."""
    start = root.rstrip("/") + "/"
    return F.when(path.startswith(start), F.substring(path, len(start) + 1, 1 << 30)).otherwise(path)
