"""Ranked lexical search, document at a time, over compressed postings in shards.

An index is a table. A shard of it is a block of documents, sorted by identifier and numbered; for
each term it holds the numbers of its documents, as differences, and its occurrences in them, both as
bytes with seven bits of a number each. A search sends each shard the postings of the wanted terms.
There a heap merges an item's postings by document number, so each document's score is complete when
it is met, and a heap bounded by k keeps the best by score, then identifier. The best of all shards
are merged in the end.
"""

from __future__ import annotations

import heapq
import itertools
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, scratch_path, slices, small_side, whole

#: What ends a term, ASCII that is neither letter nor digit.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))

K = 10
#: Terms that a shard gathers before it is closed; a longer document is a shard alone.
SHARD_TERMS = 2_000_000
#: Rows (item, term) that one round of a search sends to the workers, some 20 MB.
BLOCK_TERMS = 200_000
#: Tasks of a search, which has no more than shards.
MAX_TASKS = 10_000


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative numbers, seven bits in each, lowest first, the last one marked; and where each number ends."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >> bits > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        out[starts[has] + i] = values[has] >> 7 * i & 127
    out[ends - 1] |= 128
    return out, ends


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data & 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        out[has] |= (data[starts[has] + i] & 127).astype(np.int64) << 7 * i
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of byte strings that lie one after the other in data."""
    offsets = np.append(0, ends).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


class ShardBuilder:
    """Gathers the terms of a block of documents and makes its rows of the index."""

    def __init__(self, kind: pa.DataType) -> None:
        self.kind = kind
        self.vocabulary: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids: list[object] = []
        self.terms: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: object, text: str) -> None:
        """A document without terms is not kept: it counts nowhere and no search finds it."""
        words = text.encode().translate(TERM_BYTES).split()
        if words:
            self.ids.append(doc)
            self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row per term with its postings, and one without a term that holds identifiers and lengths."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i]))
        lengths = np.array([len(self.terms[i]) for i in order], np.int64)
        number = np.repeat(np.arange(len(order)), lengths)
        postings, counts = np.unique(np.concatenate([self.terms[i] for i in order]).astype(np.int64) * len(order) + number, return_counts=True)
        term, doc = np.divmod(postings, len(order))
        last = np.append(np.flatnonzero(np.diff(term)), len(term) - 1)
        gaps = np.diff(doc, prepend=0)
        first = np.append(0, last[:-1] + 1)
        gaps[first] = doc[first]
        (docs, doc_ends), (times, time_ends), (sizes, _) = pack_numbers(gaps), pack_numbers(counts), pack_numbers(lengths)
        n = len(last)
        columns = {
            "shard": pa.array([shard] * (n + 1), pa.int64()),
            "term": pa.array([*(t.decode() for t in self.vocabulary), None], pa.string()),
            "n_docs": pa.array([*(last - first + 1).tolist(), len(order)], pa.int64()),
            "n_terms": pa.array([*np.add.reduceat(counts, first).tolist(), int(lengths.sum())], pa.int64()),
            "docs": pa.concat_arrays([_binary(docs, doc_ends[last]), pa.array([None], pa.binary())]),
            "times": pa.concat_arrays([_binary(times, time_ends[last]), pa.array([sizes.tobytes()], pa.binary())]),
            "ids": pa.array([None] * n + [[self.ids[i] for i in order]], pa.list_(self.kind)),
        }
        return pa.RecordBatch.from_pydict(columns)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of all documents: shard, term, n_docs, n_terms, docs, times, ids.

    Terms are runs of ASCII letters and digits and of all other than ASCII characters, A-Z
    lower-cased. A row per shard and term holds document numbers (`docs`) and occurrences (`times`);
    the row of a shard without a term holds all its identifiers in order, and the documents' lengths
    as `times`. Null and empty texts have no terms. Repeated rows are documents each; null ids come
    first. Other columns are ignored; an empty table gives an empty index. No shuffle.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId() << 32, None
        for part in slices(batches):
            own = own or ShardBuilder(part.column(0).type)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own.add(doc, text)
                if own.size >= shard_terms:
                    yield own.rows(shard)
                    shard, own = shard + 1, ShardBuilder(own.kind)
        if own and own.ids:
            yield own.rows(shard)

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    return narrow.mapInArrow(build, f"shard bigint, term string, n_docs bigint, n_terms bigint, docs binary, times binary, ids array<{kind}>")


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(ascii_lower(text), BREAKS)), "")


class BestDocuments:
    """The k best (score, document) of those offered in ascending document order: of equal scores the first ones stay."""

    def __init__(self, k: int) -> None:
        self.k, self.heap, self.floor = k, [], 0

    def offer(self, score: int, doc: int) -> bool:
        """Whether `floor`, which a later score must exceed, has changed."""
        if score <= self.floor:
            return False
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc))
        else:
            heapq.heapreplace(self.heap, (score, -doc))
        if len(self.heap) < self.k:
            return False
        self.floor = self.heap[0][0]
        return True


def merge_postings(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of an item, whose terms have (greatest score, documents, scores) each.

    Documents come from a heap over the lists in turn. When k documents are held, the lists of the
    least scores, which together cannot lift a document over the k-th, leave the heap; they are asked
    for a document only while it can still be lifted. No document is lost by that.
    """
    lists = sorted(lists, key=lambda x: x[0])
    most = list(itertools.accumulate(x[0] for x in lists))
    best, needed, at = BestDocuments(k), 0, [0] * len(lists)
    bits = len(lists).bit_length()
    mask = (1 << bits) - 1
    heap = [own[1][0] << bits | i for i, own in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0] >> bits, 0
        while heap and heap[0] >> bits == doc:
            i = heap[0] & mask
            if i < needed:
                heapq.heappop(heap)
                continue
            _, docs, scores = lists[i]
            score += scores[at[i]]
            at[i] += 1
            if at[i] < len(docs):
                heapq.heapreplace(heap, docs[at[i]] << bits | i)
            else:
                heapq.heappop(heap)
        if not score:
            continue
        for i in range(needed - 1, -1, -1):
            if score + most[i] <= best.floor:
                break
            _, docs, scores = lists[i]
            at[i] = j = bisect_left(docs, doc, at[i])
            if j < len(docs) and docs[j] == doc:
                score += scores[j]
        if best.offer(score, doc):
            while needed < len(lists) and most[needed] <= best.floor:
                needed += 1
    return [(score, -doc) for score, doc in best.heap]


class ShardSearch:
    """The best documents of one shard for each item of a block; sent to the workers once per block."""

    def __init__(self, wanted: dict[str, tuple[int, list[int]]], n_items: int, documents: int, terms: int, k: int) -> None:
        self.wanted, self.n_items, self.documents, self.terms, self.k = wanted, n_items, documents, terms, k

    def find(self, rows: pa.Table) -> tuple[list[int], list[object], list[int]]:
        held = rows.filter(pc.is_null(rows["term"]))
        own = rows.filter(pc.is_valid(rows["term"]))
        ids = held["ids"][0].values.to_pylist()
        lengths = unpack_numbers(np.frombuffer(held["times"][0].as_py(), np.uint8))
        size = 8 * (10 + 90 * lengths * self.documents // self.terms)
        lists: list[list[tuple[int, list[int], list[int]]]] = [[] for _ in range(self.n_items)]
        for term, docs, times in zip(own["term"].to_pylist(), own["docs"].to_pylist(), own["times"].to_pylist(), strict=True):
            at = np.cumsum(unpack_numbers(np.frombuffer(docs, np.uint8)))
            often = unpack_numbers(np.frombuffer(times, np.uint8))
            weight, asked_by = self.wanted[term]
            scores = weight * (1_000_000_000 * often // (1000 * often + size[at]))
            entry = int(scores.max()), at.tolist(), scores.tolist()
            for item in asked_by if entry[0] else ():
                lists[item].append(entry)
        found = [(item, ids[doc], score) for item, own_lists in enumerate(lists) for score, doc in merge_postings(own_lists, self.k)]
        return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


def search(index: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each item: item, rank (from 1), document, score; documents with score 0 are left out.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its share in a document's score is
    weight * (10^9 tf div (1000 tf + 8 m)) with m = 10 + (90 n N) div L: N documents with terms, L
    terms in all, n in the document, tf of them this one. Equal scores rank by ascending identifier.
    Rows with an equal item are one item, with all their terms; items without terms, and empty
    tables, give no rows. Items are searched in blocks of about `block_terms` distinct terms of
    items, each against all shards, so what a block broadcasts is bounded however many items there
    are (an item with more terms is a block alone). `index` must be stored: it is read several times.
    """
    spark = index.sparkSession
    wanted = materialize(items.select(F.col(item_col).alias("_item"), F.explode(terms_of(whole(text_col))).alias("term")).distinct())
    blocks = max(1, -(-wanted.count() // block_terms))
    totals = index.filter("term is null").agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    documents, terms, shards = (x or 0 for x in totals)
    kind, doc_kind = items.schema[item_col].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    out = f"_item {kind}, _doc {doc_kind}, score bigint"
    found = spark.createDataFrame([], out)
    for block in range(blocks if documents else 0):
        found = found.unionAll(_search_block(index, wanted.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block), documents, terms, min(shards, MAX_TASKS), k, out))
    by = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc("_doc"))
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_item").alias(item_col), "rank", F.col("_doc").alias(id_col), "score")


def _search_block(index: DataFrame, wanted: DataFrame, documents: int, terms: int, tasks: int, k: int, out: str) -> DataFrame:
    distinct = small_side(materialize(wanted.select("term").distinct()))
    postings = index.filter("term is not null").join(distinct, "term", "left_semi")
    held = postings.groupBy("term").agg(F.sum("n_docs").alias("_df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("_df") + 1).cast("double"))).cast("bigint")
    rows = wanted.join(held, "term").select("_item", "term", weight.alias("weight")).toArrow()
    values = pc.unique(rows["_item"].combine_chunks()) if rows.num_rows else pa.array([], rows.schema.field("_item").type)
    numbers = {v: i for i, v in enumerate(values.to_pylist())}
    asked: dict[str, tuple[int, list[int]]] = {}
    for item, term, weight in zip(*(rows[c].to_pylist() for c in ("_item", "term", "weight")), strict=True):
        asked.setdefault(term, (weight, []))[1].append(numbers[item])
    shared = index.sparkSession.sparkContext.broadcast((ShardSearch(asked, len(numbers), documents, terms, k), values))

    def find(shard: pa.Table) -> pa.Table:
        searcher, items = shared.value
        item, doc, score = searcher.find(shard)
        return pa.table({"_item": items.take(pa.array(item, pa.int64())), "_doc": pa.array(doc, shard.schema.field("ids").type.value_type), "score": pa.array(score, pa.int64())})

    columns = ["shard", "term", "docs", "times", "ids"]
    rows = postings.select(columns).unionAll(index.filter("term is null").select(columns))
    # A shard's postings are few bytes and much work, so tasks are not joined by their bytes.
    return rows.repartition(tasks, "shard").groupBy("shard").applyInArrow(find, out)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Index all documents into a table in the shared folder and search it for all items; see build_index and search."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "index")
    build_index(docs, id_col, text_col).write.parquet(path)
    return search(spark.read.parquet(path), items, k, item_col, text_col, id_col)
