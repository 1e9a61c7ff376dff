"""BPE encoding and decoding with a contiguous rank array.

A short word is held as part boundaries, the parts' ids, and the ranks of adjacent pairs. The minimum
rank is found by a scan, its boundary deleted and the two neighbouring ranks refreshed, until no pair
can merge. Words repeat, so each Python worker keeps the ids of words, and of what stands between
spaces, that it has met (bounded caches).
Long words, for which scans would be quadratic, keep the ranks in a heap instead, with equal results.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole

#: A rank and the id it merges to share one integer, the rank above.
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = 1 << 60
LONG_WORD = 128
CACHE_WORDS = 600_000
#: A longer word or chunk is not kept, so that a cache is bounded in bytes too.
CACHE_CHARS = 64
#: Letters that every Unicode version composes, lower-cases and classifies alike; texts with others
#: go through the tokenizer file's own normaliser and splitter before the merges.
EXOTIC = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-ſ‐-‧]")
#: Fixed value: the split of byte-level tokenizer files that name no pattern.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(kept)]
    return [chr(b) if b in set(kept) else chr(256 + others.index(b)) for b in range(256)]


class _Cache(dict):
    """Values made on demand; emptied when full and closed to long keys, so that memory is bounded."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class RankArrayBPE:
    """Encoder and decoder made from a tokenizers JSON file; the file's path is a parameter."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << ID_BITS | vocab[right], rank << ID_BITS | vocab[left + right])
        for token in spec["added_tokens"]:
            if odd := [k for k in ("lstrip", "rstrip", "single_word", "normalized") if token.get(k)]:
                raise ValueError(f"added token {token['content']!r} has {odd}, which are not supported")
        # One that the vocabulary holds too has its number there.
        self.special = {t["content"]: vocab.get(t["content"], t["id"]) for t in spec["added_tokens"]}
        # A text without any of their beginnings holds none of them.
        self.special_starts = sorted({t[:2] for t in self.special})
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        # Bytes without a token have none in the output either.
        self.inner = [vocab.get(c) for c in letters]
        self.final = [vocab.get(c + suffix) for c in letters]
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = next((p["pattern"]["Regex"] for p in parts if p["type"] == "Split"), None)
        self.pattern = regex.compile(split or BYTE_PATTERN)
        self.keeps_spaces = split is None
        self.lower = spec["normalizer"] is not None
        library = Tokenizer.from_file(path)
        self.normaliser, self.splitter = library.normalizer, library.pre_tokenizer
        self.words = _Cache(lambda word: self.word_ids(word.encode("utf-8", "surrogatepass")))
        self.mapped = _Cache(lambda word: self.word_ids(bytes(map(self.bytes_of.__getitem__, word))))
        self.chunks = _Cache(lambda chunk: self.word_ids(chunk.encode()) if chunk.isalpha() else self._chunk(chunk))
        self.spaced = _Cache(lambda chunk: self.word_ids(b" " + chunk.encode()) if chunk.isalpha() else self._chunk(" " + chunk))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.words[w] for w in self.pattern.findall(chunk)])

    def word_ids(self, word: bytes) -> bytes:
        """The packed ids of a word."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.final[word[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        return packed(self.merge_long(ids) if len(ids) > LONG_WORD else self.merge(ids))

    def merge(self, ids: list[int]) -> list[int]:
        """ids and ranks run side by side: ranks[i] is that of the boundary between parts i and i + 1."""
        rank = self.ranks.get
        ids = list(ids)
        ranks = [rank(a << ID_BITS | b, NO_RANK) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            lowest = min(ranks)
            if lowest == NO_RANK:
                break
            i = ranks.index(lowest)
            ids[i] = new = lowest & ID_MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << ID_BITS | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(new << ID_BITS | ids[i + 1], NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, with a heap of (rank, place) over linked parts."""
        rank = self.ranks.get
        ids, n = list(ids), len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << ID_BITS | ids[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            lowest, i = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or rank(ids[i] << ID_BITS | ids[j]) != lowest:
                continue
            ids[i], alive[j], after[i] = lowest & ID_MASK, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := rank(ids[left] << ID_BITS | ids[after[left]], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, left))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def _segment(self, text: str) -> bytes:
        if EXOTIC.search(text):
            text = self.normaliser.normalize_str(text) if self.normaliser else text
            return b"".join([self.mapped[w] for w, _ in self.splitter.pre_tokenize_str(text)])
        if self.lower:
            text = text.lower()
        if not self.keeps_spaces:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        # A word may hold one space before it, so single spaces part the text; runs of white space need the pattern.
        if "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or text[:1] == " " or text[-1:] == " ":
            return self._chunk(text)
        first, *rest = text.split(" ")
        return self.chunks[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text. Strings of special tokens become their ids, as in the library."""
        if any(start in text for start in self.special_starts):
            parts = self.special_pattern.split(text)
            return b"".join([packed([self.special[p]]) if i % 2 else self._segment(p) for i, p in enumerate(parts) if p])
        return self._segment(text)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included: bytes where the file has a byte decoder, else tokens joined by spaces."""
        tokens = [self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]
        if not self.byte_decoder:
            return " ".join(tokens)
        out, run = [], bytearray()
        for token in tokens:
            run += bytes(self.bytes_of[c] for c in token) if all(c in self.bytes_of for c in token) else token.encode()
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)


class LibraryBPE(RankArrayBPE):
    """The same splitting and caches, with the tokenizers library's own merges for each new word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.letters, self.model = byte_letters(), Tokenizer.from_file(path).model

    def word_ids(self, word: bytes) -> bytes:
        return packed([t.id for t in self.model.tokenize("".join([self.letters[b] for b in word]))])


_loaded: dict[tuple[type, str], RankArrayBPE] = {}


def loaded(path: str, kind: type[RankArrayBPE] = RankArrayBPE) -> RankArrayBPE:
    """One encoder per file and Python worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (packed little-endian unsigned 32-bit integers).

    A null text counts as empty and has no ids. Repeated rows stay; other columns are ignored. An
    empty table gives an empty result.
    """
    return _coded(docs, path, id_col, text_col, decode=False)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents, and `decoded`: the text that the packed ids decode to."""
    return _coded(docs, path, id_col, text_col, decode=True)


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, decode: bool) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in slices(batches):
            ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "decoded"][: len(columns)])

    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    schema = f"_id {_kind(docs, id_col)}, ids binary" + ", decoded string" * decode
    return narrow.mapInArrow(code, schema).withColumnRenamed("_id", id_col)
