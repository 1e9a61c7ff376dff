"""The volume source: rows as of whole files, and the bytes it reads."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua import contracts
from residua.sources import volume_source, volumes


def nifti(array, kind="<f4", code=16, slope=2.0, intercept=1.0):
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, 3, *array.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", header, 70, code, np.dtype(kind).itemsize * 8)
    struct.pack_into("<3f", header, 108, 352.0, slope, intercept)
    return bytes(header) + array.astype(kind).tobytes(order="F")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, top = np.random.default_rng(3), tmp_path_factory.mktemp("volumes")
    for i, depth in enumerate((40, 7, 1)):
        np.save(top / f"sub-{i}.npy", rng.random((1, 1, depth, 9, 11)).astype(np.float32))
    np.save(top / "turned.npy", np.asfortranarray(rng.random((6, 5, 4))))
    (top / "deep").mkdir()
    (top / "deep" / "scan_t2.nii").write_bytes(nifti(rng.integers(0, 99, (9, 8, 20)), "<i2", 4, 0.5, 3.0))
    (top / "deep" / "scan_t1.nii.gz").write_bytes(gzip.compress(nifti(rng.random((30, 30, 50)))))
    return str(top)


def keyed(frame):
    return {(r["volume_id"], r["slice_index"]): (r["height"], r["width"], list(r["pixels"])) for r in frame.collect()}


@pytest.mark.parametrize("glob", ["*.npy", "*.nii", "*.nii.gz"])
@pytest.mark.parametrize("range_bytes", [100, 1500, 1 << 26])
def test_rows_are_those_of_whole_files(spark, folder, glob, range_bytes):
    found = volume_source.scan_slices(spark, folder, glob, range_bytes=range_bytes)
    assert keyed(found) == keyed(volumes.read_volumes(spark, folder, glob))
    assert found.filter(F.col("chunk_index") != F.floor(F.col("slice_index") / 16)).isEmpty()


def test_ranges_split_a_file(spark, folder):
    assert volume_source.scan_slices(spark, folder, "sub-0.npy", range_bytes=2000).rdd.getNumPartitions() == 8
    assert volume_source.scan_slices(spark, folder, "*.npy").rdd.getNumPartitions() == 1


def test_depths_read_headers_alone(spark, folder):
    found = {r["volume_id"]: r for r in volume_source.scan_headers(spark, folder).collect()}
    assert {k: (r["depth"], r["n_chunks"]) for k, r in found.items()} == {"sub-0": (40, 3), "sub-1": (7, 1), "sub-2": (1, 1), "turned": (6, 1)}
    assert all(r["bytes_read"] == 128 for r in found.values())
    assert volume_source.scan_headers(spark, folder, "*.nii").first()["bytes_read"] == 352
    packed = volume_source.scan_headers(spark, folder, "*.nii.gz").first()
    assert packed["depth"] == 50 and packed["bytes_read"] < 140_000


def test_one_chunk_reads_only_its_bytes(spark, folder):
    slice_bytes = 9 * 11 * 4
    chunk = volume_source.read_chunk(spark, folder, "sub-0", 1)
    assert sorted(r["slice_index"] for r in chunk.collect()) == list(range(16, 32))
    assert chunk.agg(F.sum("bytes_read")).first()[0] == 128 + 16 * slice_bytes
    some = volume_source.scan_slices(spark, folder, "*.npy").filter("volume_id like 'sub-%' and slice_index in (0, 3)")
    assert some.agg(F.sum("bytes_read")).first()[0] == 3 * 128 + 5 * slice_bytes
    assert keyed(some).keys() == {("sub-0", 0), ("sub-0", 3), ("sub-1", 0), ("sub-1", 3), ("sub-2", 0)}
    assert volume_source.read_chunk(spark, folder, "sub-0", 9).isEmpty() and volume_source.read_chunk(spark, folder, "none", 0).isEmpty()


def test_a_narrow_schema_reads_no_voxels(spark, folder):
    found = volume_source.scan_slices(spark, folder, "sub-*.npy", columns=["volume_id", "slice_index", "bytes_read"])
    assert found.columns == ["volume_id", "slice_index", "bytes_read"] and found.count() == 48
    assert found.agg(F.sum("bytes_read")).first()[0] == 3 * 128
    with pytest.raises(contracts.DataError, match="depth"):
        volume_source.scan_slices(spark, folder, columns=["depth"])


def test_without_pushdown_rows_are_the_same(spark, folder):
    spark.conf.set(volume_source.PUSHDOWN, "false")
    try:
        plain = keyed(volume_source.read_chunk(spark, folder, "sub-0", 1))
    finally:
        spark.conf.set(volume_source.PUSHDOWN, "true")
    assert plain == keyed(volume_source.read_chunk(spark, folder, "sub-0", 1))


def test_broken_files_and_missing_folders_raise(spark, tmp_path):
    assert volume_source.scan_slices(spark, str(tmp_path)).count() == 0
    (tmp_path / "short.npy").write_bytes((lambda b: b[:-8])(volumes_bytes(np.zeros((2, 3, 4)))))
    with pytest.raises(Exception, match="ends early"):
        volume_source.scan_slices(spark, str(tmp_path)).collect()
    (tmp_path / "short.npy").write_bytes(b"")
    with pytest.raises(Exception, match="not an array file"):
        volume_source.scan_slices(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no folder"):
        volume_source.scan_slices(spark, str(tmp_path / "none")).collect()


def volumes_bytes(array):
    import io

    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()
