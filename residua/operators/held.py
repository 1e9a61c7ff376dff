"""Frames that are kept while they are used: in the executors' storage, or in the shared folder."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ConfigError
from ..sources.committed import located


@contextmanager
def held(rows: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """The rows, kept at the storage level until the block ends, however it ends. A lost executor's part is made again."""
    kept = rows.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def held_share(rows: DataFrame, key: str, rate: float, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, seed: int = 42) -> Iterator[DataFrame]:
    """The rows, with those of a share `rate` of the keys kept: for what is read in every epoch and fits only in part.

    The keys are chosen by a seeded hash, so every epoch keeps the same; the others are made anew each
    time. A null key is never kept.
    """
    if not 0 <= rate <= 1:
        raise ConfigError(f"a share lies in [0, 1], not {rate}")
    chosen = F.coalesce(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < round(rate * (1 << 20)), F.lit(False))
    with held(rows.filter(chosen), level) as kept:
        yield kept.unionByName(rows.filter(~chosen))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); only a local master gets one made where nothing set it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="residua-checkpoints-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(rows: DataFrame) -> DataFrame:
    """The rows, evaluated once into a table of the shared folder and read from there, which survives lost executors."""
    path = scratch_path(rows.sparkSession, "rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def drop_scratch(spark: SparkSession, older_than: float = 86_400.0) -> list[str]:
    """Remove what scratch paths left in the shared folder more than `older_than` seconds ago; the names.

    Frames that were made from it can then no longer be read, so it must be older than any job that runs.
    Other files of the folder stay.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        return []
    store, own = located(folder)
    limit = time.time() - older_than
    found = [x for x in store.get_file_info(fs.FileSelector(own, allow_not_found=True)) if x.type == fs.FileType.Directory and re.fullmatch(r".+-[0-9a-f]{32}", x.base_name)]
    gone = sorted(x.base_name for x in found if x.mtime and x.mtime.timestamp() < limit)
    for name in gone:
        store.delete_dir(f"{own}/{name}")
    return gone
