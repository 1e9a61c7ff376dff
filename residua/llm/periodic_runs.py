"""Periodic runs of words by bit-parallel lags.

Each bit of the numbers of a text's words is a plane: one big integer with a bit per word. For a lag,
each plane is shifted and combined with itself by exclusive-or, and the mismatches of the planes by
or: a zero says that the words a lag apart are equal. Ands of the matches with themselves, shifted by
doubling steps, leave only the starts of stretches that are long enough.
"""

from __future__ import annotations

import bisect
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole

MIN_LENGTH = 6
MIN_PERIODS = 4
#: Planes that a lag is tried on first; words differ in these as a rule.
FIRST_PLANES = 3

#: start, length, period
Run = tuple[int, int, int]


def planes(words: list[bytes]) -> list[int]:
    """One integer per bit of the words' numbers (in the order of their first place), with a bit per word."""
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    top = max(1, (len(numbers) - 1).bit_length())
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(top)]


def _long_stretches(matches: int, need: int) -> int:
    """The places from which `need` bits in a row are set."""
    have = 1
    while have < need and matches:
        step = min(have, need - have)
        matches &= matches >> step
        have += step
    return matches


def _groups(bits: int) -> Iterator[tuple[int, int]]:
    """First and one past the last place of each group of set bits."""
    at = 0
    while bits:
        gap = (bits & -bits).bit_length() - 1
        bits >>= gap
        ones = (~bits & (bits + 1)).bit_length() - 1
        yield at + gap, at + gap + ones
        bits >>= ones
        at += gap + ones


def _covered(runs: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the runs of a period, whose starts and ends both ascend, holds this stretch."""
    at = bisect.bisect_right(runs, start, key=lambda r: r[0])
    return at > 0 and runs[at - 1][1] >= end


def find_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[Run]:
    """All maximal runs (start, length, smallest period) by start, then period.

    A run has at least max(min_length, min_periods * period) words, with min_periods of 2 or more: then
    a run that also has a smaller period has a divisor of its lag as period, and lies within a run
    found at that divisor.
    """
    n, found = len(words), []
    if n < min_length or n < min_periods:
        return found
    own = planes(words)
    first, rest = own[:FIRST_PLANES], own[FIRST_PLANES:]
    by_period: dict[int, list[tuple[int, int]]] = {}
    full = (1 << n) - 1
    for lag in range(1, n // min_periods + 1):
        full >>= 1  # places that have a word a lag later
        need = max(min_length, min_periods * lag) - lag
        wrong = 0
        for plane in first:
            wrong |= plane ^ plane >> lag
        matches = ~wrong & full
        if not _long_stretches(matches, need):
            continue
        for plane in rest:
            matches &= ~(plane ^ plane >> lag)
        for start, after in _groups(_long_stretches(matches, need)):
            end = after - 1 + need + lag
            if not any(lag % period == 0 and _covered(inner, start, end) for period, inner in by_period.items()):
                by_period.setdefault(lag, []).append((start, end))
    return sorted((start, end - start, period) for period, inner in by_period.items() for start, end in inner)


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: all of it after its first period."""
    if not runs:
        return words
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, gone in zip(words, dropped, strict=True) if not gone]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period, in words from 0), collapsed.

    Words are runs of anything but ASCII white space; `collapsed` is the words that no run repeats,
    joined by one space. A null or empty text has no words, no runs and an empty `collapsed`. Repeated
    rows stay, other columns are ignored, an empty table gives an empty result. Whole texts are read:
    time grows as the square of a text's words, 64 words of a lag at a time. No shuffle.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for part in slices(batches):
            counts, runs, texts = [], [], []
            for text in part.column(1).to_pylist():
                words = text.encode().split()
                own = find_runs(words, min_length, min_periods)
                counts.append(len(words))
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in own])
                texts.append(b" ".join(collapse(words, own)).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(step)), pa.array(texts, pa.string())], ["_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    schema = f"_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return narrow.mapInArrow(find, schema).withColumnRenamed("_id", id_col)
