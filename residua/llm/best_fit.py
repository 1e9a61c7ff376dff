"""Best-fit decreasing packing of whole documents, with a segment tree over remaining capacities.

A document's ids are cut only where it is longer than a sequence. Pieces are placed from the longest
to the shortest, each into the open sequence with the least room that holds it. What that rule does
depends on the number of pieces of each length alone, and there are at most `window` lengths: so the
rule runs over their counts, which Spark sums, and gives a plan of bounded size however many
documents there are. A segment tree over remaining capacities finds the tightest open sequences in
logarithmic time, and one search serves all sequences of that room and all pieces of that length.
Pieces then look their places up by length and number among the pieces of that length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LibraryBPE, loaded
from .common import scratch_path, slices, small_side, whole

WINDOW = 4096
END_ID = 1

#: length, number of the first piece of that length, pieces, pieces in a sequence, first sequence, offset
Step = tuple[int, int, int, int, int, int]


class CapacityTree:
    """A segment tree over capacities 0..top; a leaf holds the groups of open sequences with that room."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << (top + 1).bit_length()
        self.some = [False] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mark(self, capacity: int, some: bool) -> None:
        at = capacity + self.leaves
        while at and self.some[at] != some:
            self.some[at] = some
            at //= 2
            if at:
                some = self.some[2 * at] or self.some[2 * at + 1]

    def put(self, capacity: int, first: int, count: int) -> None:
        """`count` sequences, numbered from `first`, have this room; full ones are not kept."""
        if capacity and count:
            self.groups[capacity].append((first, count))
            self._mark(capacity, True)

    def take(self, capacity: int) -> tuple[int, int]:
        group = self.groups[capacity].pop()
        if not self.groups[capacity]:
            self._mark(capacity, False)
        return group

    def tightest(self, size: int) -> int | None:
        """The least capacity of at least `size` that an open sequence has."""
        at = size + self.leaves
        while not self.some[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at + (not self.some[2 * at])
        return at - self.leaves


def plan(counts: dict[int, int], window: int) -> list[Step]:
    """The steps of best-fit decreasing over so many pieces of each length.

    Equal to placing piece by piece: while a sequence keeps room for another piece of the same
    length it is also the tightest, so it takes all that fit before the next one is asked. A length
    opens and splits two groups at most, and lengths in a sequence differ at every step, so steps are
    bounded by the window.
    """
    tree, steps, sequences = CapacityTree(window), [], 0
    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, held = window, sequences, -(-left // (window // size))
                sequences += held
            else:
                first, held = tree.take(room)
            each = room // size
            filled = min(held, left // each)
            if filled:
                steps.append((size, at, filled * each, each, first, window - room))
                tree.put(room - each * size, first, filled)
                at, left, first, held = at + filled * each, left - filled * each, first + filled, held - filled
            if left and held:
                steps.append((size, at, left, left, first, window - room))
                tree.put(room - left * size, first, 1)
                at, left, first, held = at + left, 0, first + 1, held - 1
            if held:
                tree.put(room, first, held)
    return steps


def cut_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: _id, piece, start, length, ids, and _task, _rank: its number among the task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, width = loaded(path, LibraryBPE), END_ID.to_bytes(4, "little"), 4 * window
        task, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        for part in slices(batches):
            kind, rows = part.column(0).type, []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packed = bpe.encode(text) + end
                for piece, at in enumerate(range(0, len(packed), width)):
                    ids = packed[at : at + width]
                    length = len(ids) // 4
                    rows.append((doc, piece, at // 4, length, ids, task, seen[length]))
                    seen[length] += 1
            if rows:
                doc, piece, start, length, ids, tasks, rank = zip(*rows, strict=True)
                arrays = [pa.array(doc, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tasks, pa.int64()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "piece", "start", "length", "ids", "_task", "_rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    return narrow.mapInArrow(cut, f"_id {kind}, piece int, start bigint, length bigint, ids binary, _task bigint, _rank bigint")


class Places:
    """Looks up sequence and offset of pieces by length and number; sent to the workers once."""

    def __init__(self, steps: Sequence[Step]) -> None:
        table = np.array(sorted(steps), np.int64).reshape(-1, 6)
        self.size, self.at, _, self.each, self.first, self.offset = table.T
        # Steps of a length follow each other without gaps, so one search over (length, number) finds the step.
        self.sizes, self.from_step = np.unique(self.size, return_index=True)
        self.to_step = np.append(self.from_step[1:], len(table))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.sizes, length)
        low, high = self.from_step[row], self.to_step[row]
        while (open_ := high - low > 1).any():
            middle = (low + high) // 2
            up = open_ & (self.at[np.minimum(middle, len(self.at) - 1)] <= rank)
            low, high = np.where(up, middle, low), np.where(open_ & ~up, middle, high)
        turn = rank - self.at[low]
        return self.first[low] + turn // self.each[low], self.offset[low] + turn % self.each[low] * length


def pack_best_fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (packed), sequence_id, offset.

    A document is its token ids and an end id; a null or empty text is just the end id. Only longer
    documents are cut, into pieces of `window` ids and a rest. Repeated rows are packed each, other
    columns are ignored, an empty table gives an empty result. Pieces are tokenised once, into a
    scratch table in the shared folder, so their numbers stay as they are when an executor is lost.
    Only the counts of lengths (a row each, `window` at most) come to the driver, and only the plan
    goes from it to the workers.
    """
    spark = docs.sparkSession
    scratch = scratch_path(spark, "pieces")
    cut_documents(docs, path, id_col, text_col, window).write.option("compression", "zstd").parquet(scratch)
    pieces = spark.read.parquet(scratch)
    per_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(counts, window)))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("_task", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = pieces.join(small_side(starts), ["_task", "length"]).withColumn("_place", place(F.col("length"), F.col("_rank") + F.col("_before")))
    return placed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids", "_place.sequence_id", "_place.offset")
