"""Sum-of-squares online packing of token sequences.

Documents are cut into full windows and a rest. Each rest goes to the fill level that minimises the
sum of squared counts of partially filled windows; the counts lie in one array over levels. What is
still open when a task ends, or when too many windows are open, is cut again into full windows; the
last one is cut at powers of two, which need no padding. Each task packs its own rows in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LibraryBPE, loaded
from .common import slices, whole

WINDOW = 1024
#: Open windows a task may hold, WINDOW ids each at most.
MAX_OPEN = 4096
END_ID = 0

#: doc, start, length, packed ids, tokens of the document
Piece = tuple[object, int, int, bytes, int]


class SumOfSquares:
    """Packs pieces; `done` gathers rows (doc, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, max_open: int, first_sequence: int = 0) -> None:
        self.window, self.max_open, self.sequence = window, max_open, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.done: list[tuple] = []

    def level_for(self, size: int) -> int:
        """The level (0: a new window) after which the sum of squares is least; of equal ones the fullest."""
        counts, room = self.counts, self.window - size
        change = 2 * (counts[size:] - counts[: room + 1]) + 2
        change[room] = 1 - 2 * counts[room]  # a full window is no longer counted
        change[0] = 2 * counts[size] + 1 if room else 0
        usable = counts[: room + 1] > 0
        usable[0] = True
        levels = np.flatnonzero(usable)
        scores = change[levels]
        return int(levels[len(levels) - 1 - np.argmin(scores[::-1])])

    def add(self, piece: Piece) -> None:
        size = piece[2]
        level = self.level_for(size)
        if level:
            held = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            self._emit(held)
            return
        self.open.setdefault(level + size, []).append(held)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self._settle(last=False)

    def add_document(self, doc: object, packed: bytes) -> None:
        """Cut the document's packed ids into full windows and a rest; place the rest."""
        total, width = len(packed) // 4, 4 * self.window
        for at in range(0, len(packed), width):
            ids = packed[at : at + width]
            piece = (doc, at // 4, len(ids) // 4, ids, total)
            if len(ids) == width:
                self._emit([piece])
            else:
                self.add(piece)

    def _emit(self, held: list[Piece]) -> None:
        offset = 0
        for doc, start, length, ids, total in held:
            self.done.append((doc, start, length, ids, total, self.sequence, offset))
            offset += length
        self.sequence += 1

    def _settle(self, last: bool) -> None:
        """Cut all open windows again: into full ones, and at the end into powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for held in self.open[level] for p in held]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        left, at, used = sum(p[2] for p in pieces), 0, 0
        while at < len(pieces):
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            if left < self.window and not last:
                size = left
            held, room = [], size
            while room:
                doc, start, length, ids, total = pieces[at]
                take = min(room, length - used)
                held.append((doc, start + used, take, ids[4 * used : 4 * (used + take)], total))
                room, used = room - take, used + take
                if used == length:
                    at, used = at + 1, 0
            left -= size
            if size < self.window and not last:
                self.open[size], self.n_open = [held], 1
                self.counts[size] = 1
            else:
                self._emit(held)

    def finish(self) -> None:
        self._settle(last=True)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: id, start, length, ids (packed), doc_tokens, sequence_id, offset.

    A document is its token ids and an end id. A null or empty text is just the end id. Repeated rows
    are packed each. Pieces of a sequence lie in the task that made it; sequence_id holds the task's
    number above 2**40. An empty table gives an empty result.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, LibraryBPE)
        packer = SumOfSquares(window, max_open, TaskContext.get().partitionId() << 40)
        end = END_ID.to_bytes(4, "little")

        def rows() -> Iterator[pa.RecordBatch]:
            if out := packer.take():
                doc, start, length, ids, total, sequence, offset = zip(*out, strict=True)
                numbers = [pa.array(x, pa.int64()) for x in (start, length)], [pa.array(x, pa.int64()) for x in (total, sequence, offset)]
                names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(doc, kind), *numbers[0], pa.array(ids, pa.binary()), *numbers[1]], names)

        kind = None
        for part in slices(batches):
            kind = part.column(0).type
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packer.add_document(doc, bpe.encode(text) + end)
            yield from rows()
        packer.finish()
        yield from rows()

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    schema = f"_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return narrow.mapInArrow(pack, schema).withColumnRenamed("_id", id_col)
