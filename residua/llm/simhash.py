"""SimHash near-dedup: tiled exact comparison.

Equal fingerprints are one node. Nodes are put into tiles by population counts: those of the
fingerprint's segments, or the band of the number of shingles. Only pairs of tiles whose counts are
near enough to hold a link are formed; inside a pair all fingerprints are compared with exclusive-or
and bit counts in numpy. A pair of tiles returns a spanning forest of its links, not all links, so a
group of near copies never yields its square. Components follow by Spark joins.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_side, whole
from .components import connected_components

#: Fixed values of the contract: seed, words of a shingle, radius.
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Segments whose population counts make the tile key: more segments, fewer pairs of more tiles.
SEGMENTS = 3
#: Nodes of a tile, about; a key with more nodes has several tiles.
TILE_ROWS = 8192
#: Near copies on word shingles: five words, Jaccard similarity 0.8. At this similarity two fingerprints of
#: 256 bits differ in 38.8 bits with a deviation of 5.7, and in 19.4 of the first 128 with one of 4.1; unrelated
#: ones in 128 and 64. The radii are 4.5 deviations or more from both. Where a text has few shingles, which
#: scatter more, `shared_links` finds all.
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8
NEAR_BITS = 256
NEAR_RADIUS = 64
COARSE_BITS = 128
COARSE_RADIUS = 38
SHORT_SHINGLES = 64
#: A block of a group of candidates: so many shingles, about, where a document costs some beside its own.
BLOCK_SHINGLES = 1_000_000
DOCUMENT_SHINGLES = 256

#: Tile pairs with up to so many links are rid of links inside one tree between looks at the rest.
_LOOK = 2048
_ROWS, _COLUMNS = 256, 1024


def shingles(text: str, words: int) -> list[bytes]:
    """Word shingles of the text with A-Z lower-cased; fewer words: the whole sequence; none: no shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined] if found else []
    ends = list(itertools.accumulate([len(w) + 1 for w in found]))
    return [joined[s : e - 1] for s, e in zip([0, *ends], ends[words - 1 :])]  # noqa: B905


#: Odd multipliers that make further words of a fingerprint from one hash.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashes_of(parts: Sequence[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in parts], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """A bit is 1 if set in over half the hashes; without hashes zero. `words` signed longs, the first from the hashes themselves."""
    counts = np.zeros((words, 64), np.int64)
    for i in range(0, len(hashes), 32768):
        part = hashes[i : i + 32768]
        for word in range(words):
            if word:
                part = (part ^ (part >> np.uint64(31))) * MIX[word % 2]
                part ^= part >> np.uint64(29)
            counts[word] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """_id, f0: the 64-bit fingerprint of all shingles, repeats included, for each input row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(hashes_of(shingles(text, words)))[0] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["_id", "f0"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    return narrow.mapInArrow(make, f"_id {kind}, f0 bigint")


def near_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bits: int = NEAR_BITS, short: int = SHORT_SHINGLES) -> DataFrame:
    """_id, _size (distinct shingles), f0, f1, ... over the distinct shingles, and _low for `shared_links`."""
    n, most = bits // 64, short / similarity
    schema = "_id bigint, _size bigint, " + "".join(f"f{i} bigint, " for i in range(n)) + "_low array<bigint>"
    kinds = [*[pa.int64()] * (2 + n), pa.list_(pa.int64())]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = np.unique(hashes_of(shingles(text, words)))
                low = hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1] if len(hashes) <= most else hashes[:0]
                rows.append((key, len(hashes), *fingerprint(hashes, n), low.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    narrow = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), whole(text_col).alias("_text"))
    return narrow.mapInArrow(make, schema).filter("_size > 0")


def segment_counts(column: str, segments: int) -> list[Column]:
    """The population counts of the fingerprint's segments."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [F.bit_count(F.shiftrightunsigned(column, a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for a, b in itertools.pairwise(cuts)]


def ball(dimensions: int, radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps with a sum of absolute values within the radius, and no step."""
    steps = (s for s in itertools.product(range(-radius, radius + 1), repeat=dimensions) if sum(map(abs, s)) <= radius)
    return [s for s in steps if s >= (0,) * dimensions]


_BASE = 1024


def tile_links(nodes: DataFrame, counts: Sequence[Column], steps: Sequence[Sequence[int]], radius: int, words: int = 1, coarse: tuple[int, int] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that span what links of up to `radius` bits connect.

    nodes: _rep (a distinct identifier), f0 ... Tiles are keyed by `counts`, non-negative and below
    500; two tiles are compared when their counts differ by one of `steps`. coarse: (words, bits), a
    radius over the first words beyond which the rest is not looked at.
    """
    key = sum(((c + 256).cast("bigint") * F.lit(_BASE**i).cast("bigint") for i, c in enumerate(counts)), F.lit(0).cast("bigint"))
    fps = [f"f{i}" for i in range(words)]
    keyed = nodes.select("_rep", *fps, key.alias("_key"))
    # A row per combination of counts: some thousands, however many the nodes.
    tiles_of = keyed.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_tiles"))
    tiled = keyed.join(F.broadcast(tiles_of), "_key").withColumn("_tile", F.pmod(F.xxhash64("_rep", F.lit(1)), F.col("_tiles")).cast("int"))
    tiles = materialize(_packed(tiled, fps))
    names = tiles.select("_key", "_tile")
    offsets = F.array(*(F.lit(sum(s * _BASE**i for i, s in enumerate(step))).cast("bigint") for step in steps))
    left = names.select(F.col("_key").alias("_ka"), F.col("_tile").alias("_ta"), F.explode(offsets).alias("_step")).withColumn("_kb", F.col("_ka") + F.col("_step"))
    pairs = left.join(small_side(names.select(F.col("_key").alias("_kb"), F.col("_tile").alias("_tb"))), "_kb").filter("_step <> 0 or _ta <= _tb")
    first = tiles.select(F.col("_key").alias("_ka"), F.col("_tile").alias("_ta"), F.col("_nodes").alias("_na"))
    second = tiles.select(F.col("_key").alias("_kb"), F.col("_tile").alias("_tb"), F.col("_nodes").alias("_nb"))
    joined = pairs.join(first, ["_ka", "_ta"]).join(second, ["_kb", "_tb"])
    same = (F.col("_ka") == F.col("_kb")) & (F.col("_ta") == F.col("_tb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            sides = [_arrays(batch.column(i), words) for i in (0, 1)]
            found = [compare_tiles(a, b, one, radius, coarse) for a, b, one in zip(*sides, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return materialize(joined.select("_na", "_nb", same.alias("_same")).mapInArrow(compare, "a bigint, b bigint"))


def _packed(tiled: DataFrame, fps: Sequence[str]) -> DataFrame:
    """A row per tile: its nodes (bounded by the tile's size)."""
    return tiled.groupBy("_key", "_tile").agg(F.collect_list(F.struct(F.col("_rep"), *fps)).alias("_nodes"))


def _arrays(column: pa.ListArray, words: int) -> list[list[np.ndarray]]:
    """Per row of a list<struct> column: identifiers, then a fingerprint array per word."""
    flat = column.flatten()
    fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(words + 1)]
    cuts = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [[f[s:e] for f in fields] for s, e in itertools.pairwise(cuts.tolist())]


class _Forest:
    """Union-find over the nodes of a pair of tiles."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            more = self.parent[up]
            if (more == up).all():
                return up
            up = more

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def grow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the links, taken in order, join two trees."""
        taken, left = np.zeros(len(i), bool), np.arange(len(i))
        while len(left):
            left = left[self.roots(i[left]) != self.roots(j[left])]
            for k in left[:_LOOK].tolist():
                a, b = self.root(i[k]), self.root(j[k])
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    taken[k] = True
            left = left[_LOOK:]
        return taken


def compare_tiles(a: list[np.ndarray], b: list[np.ndarray], same: bool, radius: int, coarse: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two tiles (or inside one): identifiers of both ends."""
    n, m = len(a[0]), len(b[0])
    tree = _Forest(n if same else n + m)
    out: list[tuple] = []
    left, right = ([w.view(np.uint64) for w in side[1:]] for side in (a, b))
    first, limit = coarse or (len(left), radius)
    for y in range(0, m, _COLUMNS):
        for x in range(0, min(n, y + _COLUMNS) if same else n, _ROWS):
            distance = None
            for p, q in zip(left[:first], right[:first], strict=True):
                bits = np.bitwise_count(p[x : x + _ROWS, None] ^ q[None, y : y + _COLUMNS])
                distance = bits if distance is None else distance + bits
            near = distance <= limit
            if not near.any():
                continue
            i, j = np.nonzero(near)
            d = distance[i, j].astype(np.int64)
            i, j = i + x, j + y
            for p, q in zip(left[first:], right[first:], strict=True):
                d += np.bitwise_count(p[i] ^ q[j])
            keep = (d <= radius) & (i < j) if same else d <= radius
            i, j = i[keep], j[keep]
            taken = tree.grow(i, j if same else j + n)
            out.append((a[0][i[taken]], b[0][j[taken]]))
    if not out:
        return np.array([], np.int64), np.array([], np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest identifier
    reachable, of any type that has an order. A null or empty text has fingerprint zero and links like
    any other, as does a row with a null identifier; a component of such rows alone has none. Repeated
    rows stay. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words))
    nodes = materialize(prints.groupBy("f0").agg(F.min("_id").alias("_least")))
    links = tile_links(nodes.select("f0", F.col("f0").alias("_rep")), segment_counts("f0", segments), ball(segments, radius), radius)
    joined = nodes.join(connected_components(links).withColumnRenamed("node", "f0"), "f0", "left").select("f0", "_least", F.coalesce("component", "f0").alias("component"))
    least = joined.groupBy("component").agg(F.min("_least").alias("component_id"))
    placed = materialize(joined.join(least, "component").select("f0", "component_id"))
    return prints.join(placed, "f0").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """(node, component) for documents that near copies tie to a smaller identifier.

    Links of 256-bit SimHash fingerprints over sets of word shingles, between tiles whose shingle
    counts allow the similarity, make groups of candidates, with the links of `shared_links`. Inside
    a group every pair of documents counts whose Jaccard similarity of their whole texts' shingles
    reaches `similarity`. Documents without words are left alone. Identifiers must be integers.
    """
    kind = docs.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be of an integer type, not {kind}")
    band = F.floor(F.log("_size") / -math.log(similarity)).cast("int").alias("_band")
    prints = materialize(near_fingerprints(docs, id_col, text_col, words, similarity).select("*", band))
    bits = [f"f{i}" for i in range(NEAR_BITS // 64)]
    nodes = materialize(prints.groupBy(*bits, "_band").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")))
    candidates = tile_links(nodes, [F.col("_band")], [(0,), (1,)], NEAR_RADIUS, NEAR_BITS // 64, (COARSE_BITS // 64, COARSE_RADIUS))
    equal = prints.join(small_side(nodes.filter("_n > 1")), [*bits, "_band"]).filter("_id <> _rep").select(F.col("_rep").alias("a"), F.col("_id").alias("b"))
    groups = connected_components(candidates.unionByName(equal).unionByName(shared_links(prints)))
    return verified_components(docs, groups, id_col, text_col, words, similarity)


def shared_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all pairs that may reach the Jaccard similarity, one of few shingles.

    Of n shingles such a pair shares n times the similarity at least, so it shares one of the
    n - ceil(similarity n) + 1 with the smallest hashes on each side (_low). Documents with one of
    these in common are linked to the smallest identifier among them.
    """
    hashes = prints.select(F.col("_id").alias("b"), F.explode("_low").alias("_hash"))
    shared = materialize(hashes.groupBy("_hash").agg(F.min("b").alias("a"), F.max("b").alias("_last")).filter("a < _last").select("_hash", "a"))
    return hashes.join(small_side(shared), "_hash").filter("a <> b").select("a", "b")


def _hashed(texts: DataFrame, words: int) -> DataFrame:
    """Replace _text by _set: the distinct shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(hashes_of(shingles(t, words))).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["_id", "component", "_set"])

    return texts.select("_id", "component", "_text").mapInArrow(run, "_id bigint, component bigint, _set array<bigint>")


def _blocks(nodes: DataFrame, large: DataFrame | None, block: int) -> DataFrame:
    """A row per component and block of documents (_id, _label, _set) of about `block` shingles.

    large: components that need several blocks, with their costs.
    """
    if large is None:
        nodes = nodes.withColumn("_block", F.lit(0))
    else:
        count = F.coalesce(F.ceil(F.col("_cost") / block), F.lit(1))
        nodes = nodes.join(small_side(large), "component", "left").withColumn("_block", F.pmod(F.xxhash64("_id"), count).cast("int"))
    return materialize(nodes.groupBy("component", "_block").agg(F.collect_list(F.struct("_id", "_label", "_set")).alias("_nodes")))


def _settle(blocks: DataFrame, columns: Sequence[str], similarity: float) -> DataFrame:
    """Links (component, a, b) inside the block of each row, or between its two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                found = settle_blocks([_documents(c, r) for c in batch.columns[1:]], similarity)
                links = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[r].as_py()] * len(found), pa.int64()), *links], ["component", "a", "b"])

    return materialize(blocks.select("component", *columns).mapInArrow(run, "component bigint, a bigint, b bigint"))


def _paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each block of `first` with each block of `second` of its group, joined by group and block: a giant group's pairs lie in as many tasks as it has blocks."""
    pairs = first.select("component", F.col("_block").alias("_a")).join(second.select("component", F.col("_block").alias("_b")), "component")
    left, right = first.select("component", F.col("_block").alias("_a"), F.col("_nodes").alias("_na")), second.select("component", F.col("_block").alias("_b"), F.col("_nodes").alias("_nb"))
    return pairs.join(left, ["component", "_a"]).join(right, ["component", "_b"]).select("component", "_na", "_nb")


def verified_components(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int, similarity: float, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, component) of what all pairs in a group that reach the Jaccard similarity connect.

    groups: (node, component) of candidates, without the components' own nodes. A large group is cut
    into blocks. Each block is settled by itself and with the first block of its group. Of what is
    then still apart from the group's largest part, each document is compared with all blocks; where
    most of a group hangs together, that is a small rest.
    """
    own = groups.select(F.col("component").alias("_id"), "component").distinct()
    members = materialize(groups.select(F.col("node").alias("_id"), "component").unionByName(own))
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), whole(text_col).alias("_text"))
    sets = materialize(_hashed(texts.join(small_side(members), "_id"), words).filter("size(_set) > 0"))
    costs = sets.groupBy("component").agg(F.sum(F.size("_set") + DOCUMENT_SHINGLES).alias("_cost"))
    large = materialize(costs.filter(F.col("_cost") > block))
    several = not large.isEmpty()
    links = _settle(_blocks(sets.withColumn("_label", F.col("_id")), large if several else None, block), ["_nodes"], similarity)
    if not several:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def labelled(links: DataFrame) -> DataFrame:
        labels = connected_components(links).select(F.col("node").alias("_id"), F.col("component").alias("_new"))
        return materialize(hung.join(small_side(labels), "_id", "left").select("_id", "component", "_set", F.coalesce("_new", "_id").alias("_label")))

    names = large.select("component")
    done = links.join(small_side(names), "component", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("component"))
    links = links.join(small_side(names), "component", "left_semi")
    hung = sets.join(small_side(names), "component", "left_semi")
    blocks = _blocks(labelled(links), large, block)
    links = links.unionByName(_settle(_paired(blocks.filter("_block = 0"), blocks.filter("_block > 0")), ["_na", "_nb"], similarity))
    nodes = labelled(links)
    parts = nodes.groupBy("component", "_label").agg(F.count(F.lit(1)).alias("_n"))
    largest = materialize(parts.groupBy("component").agg(F.max(F.struct("_n", "_label")).alias("_top")).select("component", F.col("_top._label").alias("_label")))
    rest = materialize(nodes.join(small_side(largest), ["component", "_label"], "left_anti"))
    if not rest.isEmpty():
        few, all_ = _blocks(rest, large, block), _blocks(nodes, large, block)
        links = links.unionByName(_settle(_paired(few, all_), ["_na", "_nb"], similarity))
    return done.unionByName(connected_components(links))


def _documents(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers, labels, shingle counts and all shingles of the documents of one block."""
    nodes = column.slice(row, 1).flatten()
    ids, labels, sets = (nodes.field(i) for i in range(3))
    return ids.to_numpy(), labels.to_numpy(), pc.list_value_length(sets).to_numpy().astype(np.int64), sets.flatten().to_numpy()


def settle_blocks(blocks: list[tuple[np.ndarray, ...]], similarity: float) -> list[tuple[int, int]]:
    """Links at the similarity or more: in one block from each document to the smallest that it hangs
    together with there, between two blocks such as join different labels.

    Documents are ordered by their numbers of shingles, so those that may be similar to one follow it.
    """
    ids, labels, sizes, flat = (np.concatenate(x) for x in zip(*blocks, strict=True))
    side = np.repeat(np.arange(len(blocks)), [len(b[0]) for b in blocks])
    order = np.argsort(sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    words, flat = np.unique(flat, return_inverse=True)
    flat = np.concatenate([flat[starts[k] : starts[k + 1]] for k in order])
    ids, labels, sizes, side = ids[order], labels[order].copy(), sizes[order], side[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    last = np.searchsorted(sizes, sizes / similarity + 1e-6, "right")
    mask = np.zeros(len(words), np.uint8)
    out = []
    for i in range(len(ids) - 1):
        end = last[i]
        open_ = labels[i + 1 : end] != labels[i]
        if len(blocks) > 1:
            open_ &= side[i + 1 : end] != side[i]
        if not open_.any():
            continue
        own = flat[starts[i] : starts[i + 1]]
        mask[own] = 1
        common = np.add.reduceat(mask[flat[starts[i + 1] : starts[end]]], starts[i + 1 : end] - starts[i + 1], dtype=np.int64)
        mask[own] = 0
        for j in (np.flatnonzero(open_ & (common / (sizes[i] + sizes[i + 1 : end] - common) >= similarity)) + i + 1).tolist():
            if labels[j] != labels[i]:
                out.append((int(ids[i]), int(ids[j])))
                labels[labels == labels[j]] = labels[i]
    if len(blocks) > 1:
        return out
    _, place = np.unique(labels, return_inverse=True)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids)
    return [(a, b) for a, b in zip(ids.tolist(), least[place].tolist(), strict=True) if a != b]


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a near copy with a smaller identifier stands for; all columns stay.

    Rows with a null identifier stay, as do documents without words. Rows that repeat an identifier
    stay or go together.
    """
    losers = near_components(docs, id_col, text_col).select(F.col("node").alias("_loser"))
    return docs.join(small_side(losers), docs[id_col] == losers["_loser"], "left_anti")
