"""Label propagation: rounds lower the cut, down to that of a plan made with all sizes in sight."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from residua.llm import registry, sharding


def first_fit(sizes, quotas):
    """Pieces beyond one per text when the largest texts go first, whole to the first shard with room, else to the largest rooms."""
    room, cut = list(quotas), 0
    for size in sorted(sizes, reverse=True):
        shard = next((k for k, free in enumerate(room) if free >= size), None)
        if shard is not None:
            room[shard] -= size
            continue
        left, pieces = size, 0
        while left:
            shard = min(range(len(room)), key=lambda k: (room[k] < left, room[k] if room[k] >= left else -room[k]))
            take = min(left, room[shard])
            room[shard] -= take
            left, pieces = left - take, pieces + 1
        cut += pieces - 1
    return cut


def propagated(spark, sizes, singles, shards, seed=0):
    rng = random.Random(seed)
    rows = sum(sizes) + singles
    quotas = [rows // shards + (k < rows % shards) for k in range(shards)]
    start = {}
    for g, n in enumerate(sizes):
        for _ in range(n):
            at = (f"g{g}", rng.randrange(shards))
            start[at] = start.get(at, 0) + 1
    frame = spark.createDataFrame([(g, k, n) for (g, k), n in start.items()], "_group string, _shard int, _n long")
    limits = spark.createDataFrame(list(enumerate(quotas)), "_shard int, _quota long")
    pieces, history = sharding.propagate(frame, limits, singles, shards, 16)
    found = {(r["_group"], r["_shard"]): r["_n"] for r in pieces.collect()}
    load = [sum(n for (_, k), n in found.items() if k == shard) for shard in range(shards)]
    assert all(a <= b for a, b in zip(load, quotas, strict=True))
    for g, n in enumerate(sizes):
        assert sum(m for (x, _), m in found.items() if x == f"g{g}") == n
    assert history[0] == len(start) - len(sizes) and history[-1] == len(found) - len(sizes)
    assert all(b <= a for a, b in zip(history, history[1:], strict=False))
    return history, first_fit(sizes, quotas)


@pytest.mark.parametrize(
    ("sizes", "singles", "shards"),
    [([2] * 60 + [3] * 20, 400, 8), ([2] * 200, 0, 10), ([53] * 16, 64, 10), ([7, 5, 5, 4, 4, 3, 3, 3, 2, 2, 2], 3, 5), ([90, 40, 31, 30, 12, 9, 9, 2, 2], 75, 6), ([500, 2, 2], 20, 7)],
)
def test_rounds_lower_the_cut_to_that_of_first_fit(spark, sizes, singles, shards):
    history, wanted = propagated(spark, sizes, singles, shards, seed=len(sizes))
    assert history[-1] < history[0] and history[-1] <= wanted


def test_texts_that_the_free_rows_can_take_are_never_cut(spark):
    rng = random.Random(2)
    sizes = [rng.randint(2, 20) for _ in range(120)]
    history, _ = propagated(spark, sizes, 20 * 9, 9)
    assert history[-1] == 0 and len(history) > 1 and history[1] < history[0]


def test_the_query_is_decided_by_rounds_that_move_rows(spark, monkeypatch):
    seen, propagate = [], sharding.propagate

    def watched(start, *rest):
        pieces, history = propagate(start, *rest)
        before = start.select("_group", "_shard", F.col("_n").alias("_was"))
        moved = pieces.join(before, ["_group", "_shard"], "left").agg(F.sum(F.greatest(F.col("_n") - F.coalesce("_was", F.lit(0)), F.lit(0)))).first()[0]
        seen.append((history, moved))
        return pieces, history

    monkeypatch.setattr(sharding, "propagate", watched)
    rows = registry.QUERIES["op4_sharding"](spark, oracle.DATA).collect()
    (history, moved), linked = seen[0], sum(r["group_rows"] > 1 for r in rows)
    assert moved > linked / 4 and history[0] > 0 and history[-1] == 0
    assert len({(r["text_crc32"], r["size"], r["shard"]) for r in rows if r["group_rows"] > 1}) == len({(r["text_crc32"], r["size"]) for r in rows if r["group_rows"] > 1})


@pytest.mark.parametrize("places", [0, 1, 2, 3, 10, 97, 1000, 12_345])
def test_strides_meet_each_place_once(places):
    stride = sharding.stride_of(places)
    assert len({p * stride % places for p in range(places)}) == places


def test_bytes_are_about_even(spark):
    rng = random.Random(8)
    rows = [(i, f"{i} " + "x" * int(10 * 2 ** rng.uniform(0, 9))) for i in range(4000)] + [(5000 + i, f"pair {i // 2}") for i in range(24)]
    found = sharding.balanced_label_propagation(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=8).collect()
    held = [sum(r["size"] for r in found if r["shard"] == k) for k in range(8)]
    counts = [sum(r["shard"] == k for r in found) for k in range(8)]
    assert counts == [503] * 8 and max(held) < 1.05 * min(held), (counts, held)
    assert len({(r["shard"], r["slot"]) for r in found}) == 4024
