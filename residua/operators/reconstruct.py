"""Reconstructors: maps from a slice to its healthy look.

The networks of the field are opaque batch maps; any of them fits `apply_reconstructor`. Two that
Spark fits itself are here as substitutes, not as equivalents: the healthy mean and principal components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ConfigError, DataError
from .held import held


def healthy_mean(voxels: DataFrame, healthy: Column, position: str = "pos", value: str = "v", places: int = 6) -> DataFrame:
    """(position, recon): the mean over healthy voxels, rounded so that thresholds do not depend on the order of sums."""
    return voxels.filter(healthy).groupBy(position).agg(F.round(F.avg(value), places).alias("recon"))


def with_residual(voxels: DataFrame, means: DataFrame, position: str = "pos", value: str = "v") -> DataFrame:
    """Join the means, a row per position of a slice (16,384 at full size, so broadcast), and add the residual."""
    return voxels.join(F.broadcast(means), position).withColumn("residual", F.abs(F.col(value) - F.col("recon")))


def apply_reconstructor(slices: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], keys: Sequence[str], batch: int = 4) -> DataFrame:
    """Run an opaque reconstructor over `pixels` in small batches; it is made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reconstruct = make()
        for part in batches:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch].copy()
                out = reconstruct(np.stack([np.asarray(x, np.float64) for x in rows["pixels"]]))
                rows["reconstruction"] = list(np.asarray(out, np.float64))
                yield rows

    schema = slices.select(*keys, "pixels").schema.add("reconstruction", T.ArrayType(T.DoubleType()))
    return slices.select(*keys, "pixels").mapInPandas(run, schema)


#: Partial blocks that one task adds up, columns of a block beyond the wanted ones, passes at most, and how near an invariant subspace counts as found.
FAN_IN, SPARE, PASSES, TOLERANCE = 16, 8, 40, 1e-9


def _pixel_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if values.size != batch.num_rows * size:
                raise DataError(f"a slice has no {size} pixels")
            yield values.reshape(batch.num_rows, size)


def summed_blocks(slices: DataFrame, make: Callable[[np.ndarray], np.ndarray], size: int, pixels: str = "pixels", fan_in: int = FAN_IN) -> np.ndarray:
    """The sum over all slices of make(slices of a batch), arrays of one shape: a block per task, then a tree of sums.

    No task and not the driver takes more than `fan_in` blocks at once, however many tasks there are.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _pixel_batches(batches, size):
            block = make(rows)
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["part", "block"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in group["block"])
        return pa.table({"part": pa.array([group["part"][0].as_py() // fan_in], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})

    schema = "part bigint, block binary"
    source = slices.select(F.col(pixels).cast("array<double>").alias("_v"))
    parts = source.mapInArrow(partial, schema)
    tasks = source.rdd.getNumPartitions()
    while tasks > fan_in:
        parts = parts.groupBy(F.floor(F.col("part") / fan_in)).applyInArrow(add, schema)
        tasks = -(-tasks // fan_in)
    found = parts.toArrow()["block"]
    if not len(found):
        raise DataError("no slices to learn from")
    return sum(np.frombuffer(x.as_py(), np.float64) for x in found)


def pca_components(healthy: DataFrame, k: int, pixels: str = "pixels", seed: int = 42, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k principal components (pixels by k) of healthy slices, by block Krylov iteration.

    A pass multiplies the covariance with a block of k + SPARE columns: each task makes its slices'
    share, pixels by columns, and the shares are added in a tree. The covariance itself, pixels by
    pixels, is never made. All blocks together span the space in which the components are sought; passes
    end when the covariance moves none of them out of it by more than `tolerance` of the largest
    variance. Signs are such that each component's largest entry is positive. Slices of fewer than k
    dimensions give components of no variance for the rest.
    """
    first = healthy.select(F.size(pixels)).first()
    if first is None:
        raise DataError("no slices to learn from")
    size = first[0]
    if not 0 < k <= size:
        raise ConfigError(f"{k} components of {size} pixels")
    with held(healthy.select(pixels)) as rows:
        sums = summed_blocks(rows, lambda x: np.append(x.sum(axis=0), len(x)), size, pixels)
        n, mean = sums[-1], sums[:-1] / sums[-1]
        width = min(size, k + SPARE)
        block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
        basis, moved = np.zeros((size, 0)), np.zeros((size, 0))
        for _ in range(PASSES):
            sent = rows.sparkSession.sparkContext.broadcast((mean, block))
            share = lambda x, sent=sent: ((x - sent.value[0]).T @ ((x - sent.value[0]) @ sent.value[1])).ravel()
            product = summed_blocks(rows, share, size, pixels).reshape(block.shape) / max(n - 1, 1)
            sent.unpersist()
            basis, moved = np.hstack([basis, block]), np.hstack([moved, product])
            small = basis.T @ moved
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
            found = basis @ vectors
            off = np.linalg.norm(moved @ vectors - found * values, axis=0).max()
            if off <= tolerance * max(values[0], np.finfo(float).tiny) or basis.shape[1] >= size:
                break
            for _ in range(2):  # twice, so that rounding leaves the blocks at right angles
                product = product - basis @ (basis.T @ product)
                product, triangle = np.linalg.qr(product)
            block = product[:, : size - basis.shape[1]]
            if not np.abs(triangle).max() > 0:
                break
    turn = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return mean, found * np.where(turn == 0, 1, turn)


def pca_reconstruct(slices: DataFrame, keys: Sequence[str], mean: np.ndarray, components: np.ndarray) -> DataFrame:
    def make() -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: mean + (x - mean) @ components @ components.T

    return apply_reconstructor(slices, make, keys)
