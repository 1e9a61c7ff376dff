"""Connected components: union-find inside partitions, then alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_STEPS = 60
#: Links that a task contracts at once.
BLOCK_LINKS = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links that are not the smallest of their component here, and that smallest node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    lowest = np.arange(len(nodes))
    while True:
        least = np.minimum(lowest[x], lowest[y])
        before = lowest.copy()
        # Hook the roots of both ends to the lower one, then point every node at its root.
        np.minimum.at(lowest, before[x], least)
        np.minimum.at(lowest, before[y], least)
        while (lowest[lowest] != lowest).any():
            lowest = lowest[lowest]
        if (lowest == before).all():
            moved = lowest != np.arange(len(nodes))
            return nodes[moved], nodes[lowest[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Links (a > b) that connect the same nodes, of which each partition returns fewer than it has nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            links = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
            if n >= BLOCK_LINKS:
                yield rows()
                held, n = [], 0
        if held:
            yield rows()

    return edges.mapInArrow(run, "a bigint, b bigint")


def _settled(edges: DataFrame) -> bool:
    """Whether each link leads from a node without other links to a component's smallest node."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out")), F.struct(F.col("b").alias("n"), F.lit(0).alias("out")))))
    odd = ends.groupBy("n").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("all")).filter("out > 1 or out = 1 and all > 1")
    return odd.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b) but the components' own smallest nodes.

    `component` is the smallest node reachable. Links to itself and links with a null end are
    ignored; repeated links count once. Partitions contract their links first; when fewer than
    BLOCK_LINKS are left, one task ends the work. Minima are aggregated before they are joined back,
    so a node with very many links is no more than a hot key of a join, which AQE splits.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    edges = materialize(_contracted(edges).distinct())
    for _ in range(MAX_STEPS):
        if edges.count() < BLOCK_LINKS:
            edges = materialize(_contracted(edges.coalesce(1)))
            break
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        edges = materialize(_contracted(small.filter("a <> b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
