"""LM scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary, all words of all documents, and one
smoothing. The background counts every document. A document is scored by models that leave it out,
so none is favoured by its own counts; its score is the mean over its tokens of the target's loss
minus that of the background matched to the target: its counts are scaled to the target's number
of tokens, so that both are smoothed alike. Negative scores are nearer to the target.

The models hold the exact counts of every word and pair and grow with the corpus, so no task and not
the driver ever holds them. Documents are gathered into chunks; a chunk asks for each of its distinct
words and pairs once, with its own counts, at the bucket of the key; a bucket adds up what was counted
and answers each. Where there are many buckets a chunk asks FAN wider ones, which merge what some FAN
chunks ask and pass it on to FAN narrower ones each, so the rows grow as the chunks and no group as
the corpus. A frequent word is one entry per chunk, whatever its share of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, slices, whole

#: Weight of the shorter history: pseudo-counts spread by the unigram model, and by the uniform one.
PAIR_PRIOR = 8.0
WORD_PRIOR = 1.0
#: A chunk ends when it has so many tokens or documents; a longer document is a chunk of its own.
CHUNK_TOKENS = 1 << 20
#: So many documents at most, as a bitmap of Spark has bits.
CHUNK_ROWS = 1 << 15
#: Tokens of the corpus per bucket of keys.
BUCKET_TOKENS = 1 << 21
#: Buckets that a chunk asks, and chunks that a bucket hears before it passes on what they ask, about.
FAN = 256
CACHE_WORDS = 500_000
SEED = 42
#: Keys of words are even, those of pairs odd.
ODD = np.uint64(1)
#: Odd multipliers that mix the hashes of a pair.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Counts sent for a key: in all texts, in target texts, and at the end of each.
CHANNELS = 4
TABLE = "chunk string, sizes array<int>, places binary, words binary, n_tokens bigint"
ASKED = "bucket int, chunk string, n int, keys binary, counts binary"
ANSWERED = "chunk string, bucket int, n int, counts binary, n_words bigint"


class _Hashes(dict):
    """Hashes of words on demand; emptied when full, so that memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED) & ~1
        return value


def words_of(text: str) -> list[bytes]:
    """The words, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _press(values: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers are nearly free."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def _open(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


@dataclass
class Chunk:
    """Tokens of some documents: `words` are distinct hashes, `places` the tokens as places in it."""

    sizes: np.ndarray
    marks: np.ndarray
    places: np.ndarray
    words: np.ndarray

    def starts(self) -> np.ndarray:
        """Places of the first tokens of the texts that have any."""
        return (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct pairs, and each token's place in them; a text begins after word 0."""
        tokens = self.words[self.places]
        before = np.roll(tokens, 1)
        before[self.starts()] = 0
        key = (before ^ (before >> np.uint64(29))) * MIX[0] + tokens
        key = (key ^ (key >> np.uint64(32))) * MIX[1]
        return np.unique((key ^ (key >> np.uint64(29))) | ODD, return_inverse=True)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All distinct keys in order; where the tokens' words and pairs are among them."""
        pairs, at = self.pairs()
        both = np.concatenate([self.words, pairs])
        order = np.argsort(both)
        rank = np.empty(len(both), np.int64)
        rank[order] = np.arange(len(both))
        return both[order], rank[self.places], rank[len(self.words) + at]

    def counts(self, n: int, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Rows by key: counts in all texts, in target texts, and texts of each kind that end with the word."""
        marked = np.repeat(self.marks, self.sizes)
        last = words[np.cumsum(self.sizes)[self.sizes > 0] - 1]
        kept = self.marks[self.sizes > 0]
        each = ((words, pairs), (words[marked], pairs[marked]), (last,), (last[kept],))
        return np.stack([sum(np.bincount(x, minlength=n) for x in some) for some in each])

    def own(self, keys: np.ndarray) -> np.ndarray:
        """For each token, how often its key is in its text."""
        width = int(keys.max(initial=0)) + 1
        _, place, times = np.unique(np.repeat(np.arange(len(self.sizes)), self.sizes) * width + keys, return_inverse=True, return_counts=True)
        return times[place]


def cuts(keys: np.ndarray, first: int, buckets: int, of: int) -> np.ndarray:
    """Where the ranges of `buckets` buckets from `first` on, of `of` in all, begin among the ordered keys, and the end."""
    firsts = np.array([(b << 64) // of for b in range(first, first + buckets)], np.uint64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def _rows(owner: str, keys: np.ndarray, counts: np.ndarray, first: int, buckets: int, of: int) -> pa.RecordBatch:
    """What one owner asks: a row per bucket that has any of its keys."""
    ends = cuts(keys, first, buckets, of)
    rows = [(first + b, owner, int(e - s), _press(np.diff(keys[s:e], prepend=np.uint64(0))), _press(counts[:, s:e].ravel())) for b, (s, e) in enumerate(zip(ends, ends[1:], strict=False)) if e > s]
    types = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in ASKED.split(", ")])


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of the rows, their summed counts, where each row's keys are among them, and the rows' ends there."""
    keys = np.concatenate([np.cumsum(_open(x.as_py(), np.uint64), dtype=np.uint64) for x in rows.column("keys")])
    distinct, place = np.unique(keys, return_inverse=True)
    own = np.concatenate([_open(x.as_py(), np.int64).reshape(CHANNELS, -1) for x in rows.column("counts")], axis=1)
    totals = np.stack([np.bincount(place, weights=c, minlength=len(distinct)).astype(np.int64) for c in own])
    return distinct, totals, place, np.cumsum(rows.column("n").to_numpy())


def _replies(rows: pa.Table, totals: np.ndarray, place: np.ndarray, ends: np.ndarray, n_words: int) -> pa.Table:
    replies = [_press(totals[:, place[s:e]].ravel()) for s, e in zip([0, *ends], ends)]  # noqa: B905
    counted = np.zeros(len(replies), np.int64)
    counted[0] = n_words
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "n": rows.column("n"), "counts": pa.array(replies, pa.binary()), "n_words": pa.array(counted)})


def _chunk(table: pa.RecordBatch | pa.Table, i: int) -> Chunk:
    sizes = np.array(table.column("sizes")[i].as_py(), np.int64)
    bits = table.column("bitmap")[i].as_py() or b""
    marks = np.zeros(len(sizes), bool)
    found = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: len(sizes)]
    marks[: len(found)] = found
    return Chunk(sizes, marks, *(_open(table.column(n)[i].as_py(), t) for n, t in (("places", np.uint32), ("words", np.uint64))))


def gather(docs: DataFrame, path: str, kind: str, chunk_tokens: int) -> DataFrame:
    """Write docs (_id, _text) as chunks under `path` and read them again."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, made = _Hashes(), TaskContext.get().partitionId(), 0
        ids, tokens, total, names = [], [], 0, None

        def row() -> pa.RecordBatch:
            words, places = np.unique(np.concatenate(tokens), return_inverse=True)
            packed = [pa.array([_press(x)], pa.binary()) for x in (places.astype(np.uint32), words)]
            lists = pa.array([[len(t) for t in tokens]], pa.list_(pa.int32())), pa.array([ids], pa.list_(names))
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{made}"]), lists[0], *packed, pa.array([len(places)], pa.int64()), lists[1]], [*(x.split()[0] for x in TABLE.split(", ")), "ids"])

        for batch in slices(batches):
            names = batch.column(0).type
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.array([hashes[w] for w in words_of(text)], np.uint64)
                ids.append(key)
                tokens.append(found)
                total += len(found)
                if total >= chunk_tokens or len(ids) >= CHUNK_ROWS:
                    yield row()
                    ids, tokens, total, made = [], [], 0, made + 1
        if ids:
            yield row()

    docs.mapInArrow(make, f"{TABLE}, ids array<{kind}>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def mark(table: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """Write a bitmap of the documents wanted per chunk, and their tokens, under `path` and read it again.

    Only identifiers are joined. Written, the bitmaps have a known size: Spark broadcasts them to the
    chunks below its threshold and deals both sides by chunk beyond it.
    """
    rows = table.select("chunk", F.size("ids").alias("_n"), F.posexplode(F.arrays_zip("ids", "sizes")).alias("_at", "_doc"))
    rows = rows.select("chunk", "_n", "_at", F.col("_doc.ids").alias("_wanted"), F.col("_doc.sizes").alias("_size")).join(wanted, "_wanted")
    bits = F.substring(F.bitmap_construct_agg(F.col("_at").cast("bigint")), F.lit(1), F.floor((F.max("_n") + 7) / 8).cast("int"))
    rows.groupBy("chunk").agg(bits.alias("bitmap"), F.sum("_size").alias("n_target"), F.sum((F.col("_size") > 0).cast("int")).alias("n_texts")).write.parquet(path)
    return table.sparkSession.read.parquet(path)


def ask(table: DataFrame, buckets: int) -> DataFrame:
    """A row per chunk and bucket: the chunk's keys there and its own counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _chunk(batch, i)
                keys, words, pairs = chunk.keys()
                yield _rows(batch.column("chunk")[i].as_py(), keys, chunk.counts(len(keys), words, pairs), 0, buckets, buckets)

    return table.drop("ids").mapInArrow(send, ASKED)


def answer(asked: DataFrame) -> DataFrame:
    """A row per row asked: the counts over all chunks. n_words of one row of a bucket has its distinct words."""

    def merge(rows: pa.Table) -> pa.Table:
        distinct, totals, place, ends = _merged(rows)
        return _replies(rows, totals, place, ends, int((distinct & ODD == 0).sum()))

    return asked.groupBy("bucket").applyInArrow(merge, ANSWERED)


def total_counts(asked: DataFrame, owners: int, fan: int, levels: int, level: int = 1) -> DataFrame:
    """A row per row asked of the fan ** level buckets. With levels left, groups of owners ask narrower buckets together."""
    spark = asked.sparkSession
    path = scratch_path(spark, "answers")
    if level == levels:
        answer(asked).write.parquet(path)
        return spark.read.parquet(path)
    kept = scratch_path(spark, "asked")
    groups = -(-owners // fan)
    group = F.concat_ws("-", F.lit(level), "bucket", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    asked.withColumn("asker", group).write.parquet(kept)
    asked = spark.read.parquet(kept)

    def merge(rows: pa.Table) -> pa.Table:
        distinct, totals, _, _ = _merged(rows)
        first = rows.column("bucket")[0].as_py() * fan
        return pa.Table.from_batches([_rows(rows.column("asker")[0].as_py(), distinct, totals, first, fan, fan ** (level + 1))])

    def spread(rows: pa.Table, replies: pa.Table) -> pa.Table:
        distinct, _, place, ends = _merged(rows)
        first = rows.column("bucket")[0].as_py() * fan
        counts = _gathered(distinct, replies, cuts(distinct, first, fan, fan ** (level + 1)), first)
        return _replies(rows, counts, place, ends, sum(replies.column("n_words").to_pylist()))

    narrower = asked.groupBy("asker").applyInArrow(merge, ASKED)
    found = total_counts(narrower, groups, fan, levels, level + 1)
    both = asked.groupBy("asker").cogroup(found.withColumnRenamed("chunk", "asker").groupBy("asker"))
    both.applyInArrow(spread, ANSWERED).write.parquet(path)
    return spark.read.parquet(path)


def _gathered(keys: np.ndarray, replies: pa.Table, ends: np.ndarray, first: int) -> np.ndarray:
    """The counts of the ordered keys from the replies of the buckets that were asked."""
    counts = np.zeros((CHANNELS, len(keys)), np.int64)
    for bucket, found in zip(replies.column("bucket").to_pylist(), replies.column("counts"), strict=True):
        counts[:, ends[bucket - first] : ends[bucket - first + 1]] = _open(found.as_py(), np.int64).reshape(CHANNELS, -1)
    return counts


def losses(word: np.ndarray, pair: np.ndarray, history: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """-ln p(word | word before) of each token.

    word, pair: counts of the token's word and pair; history: of the pairs that begin as this one;
    total: tokens of the model. Over the vocabulary the probabilities after any history sum to 1.
    """
    single = (word + WORD_PRIOR / vocabulary) / (total + WORD_PRIOR)
    return -np.log((pair + PAIR_PRIOR * single) / (history + PAIR_PRIOR))


def score_chunk(chunk: Chunk, counts: np.ndarray, words: np.ndarray, pairs: np.ndarray, totals: tuple[int, int], texts: tuple[int, int], vocabulary: int) -> np.ndarray:
    """Rows (background, target, matched background) of mean losses by document; 0 for a document without tokens.

    totals, texts: tokens and texts with tokens, of all and of target documents. Each document's own
    counts are taken from a model that holds it.
    """
    held, starts = np.flatnonzero(chunk.sizes), chunk.starts()
    out = np.zeros((3, len(chunk.sizes)))
    if not len(held):
        return out
    size = np.repeat(chunk.sizes, chunk.sizes)
    last = np.repeat(words[starts + chunk.sizes[held] - 1], chunk.sizes[held])
    before = np.roll(words, 1)
    own_word, own_pair = chunk.own(words), chunk.own(pairs)
    own_history = np.roll(own_word, 1) - (before == last)
    own_history[starts] = 1
    inside = np.repeat(chunk.marks, chunk.sizes)
    scale = min(1.0, totals[1] / max(1, totals[0]))
    for side, times in ((0, 1), (1, inside)):
        history = counts[side][before] - counts[2 + side][before]
        history[starts] = texts[side]
        exact = (counts[side][words] - own_word * times, counts[side][pairs] - own_pair * times, history - own_history * times, totals[side] - size * times)
        for row, factor in ((side, 1.0), *(((2, scale),) if side == 0 else ())):
            lost = losses(*(x * factor for x in exact), vocabulary)
            out[row][held] = np.add.reduceat(lost, starts) / chunk.sizes[held]
    return out


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, fan: int = FAN) -> DataFrame:
    """One row per input row: id, n_tokens, target_loss, background_loss, matched_loss, score.

    The background model counts all rows, the target model those whose identifier is in `target_ids`;
    a row is scored without its own counts. matched_loss is that of the background scaled to the
    target's tokens, score is target_loss - matched_loss. A null or empty text has no tokens and scores
    0 with losses 0. Without target documents the target model is uniform and scores are 0. Null
    identifiers are no target. Repeated rows count and are scored each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = target_ids.select(F.col(id_col).alias("_wanted")).filter("_wanted is not null").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    table = gather(texts, scratch_path(spark, "chunks"), kind, chunk_tokens)
    marks = mark(table, wanted, scratch_path(spark, "marks"))
    begun = F.size(F.filter("sizes", lambda n: n > 0))
    chunks, tokens, texts_all = (int(x or 0) for x in table.agg(F.count(F.lit(1)), F.sum("n_tokens"), F.sum(begun)).first())
    target_tokens, texts_target = (int(x or 0) for x in marks.agg(F.sum("n_target"), F.sum("n_texts")).first())
    table = table.join(marks.drop("n_target", "n_texts"), "chunk", "left")
    buckets = max(1, -(-tokens // bucket_tokens))
    levels = next(n for n in range(1, 65) if fan**n >= buckets)
    width = buckets if levels == 1 else fan

    answers = total_counts(ask(table, width), chunks, width, levels)
    vocabulary = int(answers.agg(F.sum("n_words")).first()[0] or 1)

    def score(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _chunk(chunks, 0)
        keys, words, pairs = chunk.keys()
        counts = _gathered(keys, replies, cuts(keys, 0, width, width), 0)
        background, target, matched = score_chunk(chunk, counts, words, pairs, (tokens, target_tokens), (texts_all, texts_target), vocabulary)
        ids = chunks.column("ids").combine_chunks().flatten()
        return pa.table({"_id": ids, "n_tokens": chunk.sizes, "target_loss": target, "background_loss": background, "matched_loss": matched, "score": target - matched})

    both = table.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    scored = both.applyInArrow(score, f"_id {kind}, n_tokens bigint, target_loss double, background_loss double, matched_loss double, score double")
    return scored.withColumnRenamed("_id", id_col)
