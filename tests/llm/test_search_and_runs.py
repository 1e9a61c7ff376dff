"""Best-fit packing, periodic runs and ranked search against brute force, with defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from residua.llm import best_fit, periodic_runs, queries, ranked_search, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _item long, score double, piece string, shard long"
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "One TWO three"), (7, "one two three"), (8, "one two three"), (7, "one two three"),
    (9, "É é ß İ 日本語 👍 \x1c x \x00y"), (10, "w " * 30_000), (11, "a" * 20_000), (12, "same words here " * 40), (13, "<|endoftext|> x"), (None, "null id three"), (4, "one"),
]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", 0, 0.0, "clash", 7) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def all_texts(spark):
    rows = spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


# --- best-fit decreasing ---


def brute_best_fit(sizes, window):
    """Room left in each sequence, one piece at a time."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(window - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_placing_one_by_one(seed):
    rng = random.Random(seed)
    window = rng.choice([5, 16, 100, 257])
    top = rng.choice([window, window // 2, max(1, window // 7)])
    sizes = [rng.randint(1, top) for _ in range(rng.choice([1, 40, 900]))] + [rng.randint(1, top)] * rng.choice([0, 300])
    steps = best_fit.plan(Counter(sizes), window)
    places, used, at = best_fit.Places(steps), defaultdict(list), Counter()
    for size in sizes:
        sequence, offset = places.find(np.array([size]), np.array([at[size]]))
        at[size] += 1
        used[int(sequence[0])].append((int(offset[0]), size))
    for pieces in used.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= window
    assert sorted(window - sum(s for _, s in p) for p in used.values()) == brute_best_fit(sizes, window)
    assert sorted(used) == list(range(len(used)))


def test_plan_does_not_grow_with_the_documents():
    rng = random.Random(5)
    counts = {size: rng.randint(1, 9) for size in range(1, 4097)}
    small, large = best_fit.plan(counts, 4096), best_fit.plan({s: 10**9 * n + 1 for s, n in counts.items()}, 4096)
    assert len(large) < 40_000 and sum(s[2] for s in large) == sum(10**9 * n + 1 for n in counts.values())
    assert sum(s[2] for s in small) == sum(counts.values())


def test_capacity_tree():
    rng = random.Random(1)
    tree, held = best_fit.CapacityTree(50), set()
    for _ in range(600):
        c = rng.randint(1, 50)
        if c in held:
            tree.take(c)
            held.discard(c)
        else:
            tree.put(c, 0, 1)
            held.add(c)
        size = rng.randint(1, 50)
        assert tree.tightest(size) == min((x for x in held if x >= size), default=None)


def check_pieces(rows, wanted, window):
    """rows: (doc, piece, start, length, ids, sequence, offset); wanted: doc and packed ids, a pair per document."""
    whole = defaultdict(list)
    for doc, piece, start, length, ids, *_ in rows:
        assert len(ids) == 4 * length and 0 < length <= window and start == piece * window
        whole[doc].append((start, ids))
    copies = Counter(d for d, _ in wanted)
    for doc, ids in dict(wanted).items():
        cut = sorted((4 * window * i, ids[4 * window * i : 4 * window * (i + 1)]) for i in range(-(-len(ids) // (4 * window)))) * copies[doc]
        assert sorted((4 * s, x) for s, x in whole[doc]) == sorted(cut)
    sequences = defaultdict(list)
    for *_, length, _ids, sequence, offset in rows:
        sequences[sequence].append((offset, length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window
    return sequences


def test_best_fit_query(spark, all_texts):
    found = [tuple(r) for r in best_fit.pack_best_fit(spark.read.parquet(f"{oracle.DATA}/documents.parquet").repartition(5), WORD_BPE).collect()]
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    wanted = [(d, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in all_texts.items()]
    sequences = check_pieces(found, wanted, 4096)
    assert sorted(4096 - sum(n for _, n in p) for p in sequences.values()) == brute_best_fit([r[3] for r in found], 4096)
    rows = {(r["doc_id"], r["piece"]): r for r in registry.QUERIES["op11_best_fit"](spark, oracle.DATA).collect()}
    assert len(rows) == len(found)
    assert all(rows[d, p]["ids_crc32"] == zlib.crc32(ids) and rows[d, p]["length"] == n for d, p, _, n, ids, *_ in found)


@pytest.mark.parametrize("window", [4, 4096])
def test_best_fit_edges(spark, edges, window):
    found = [tuple(r) for r in best_fit.pack_best_fit(edges, WORD_BPE, window=window).collect()]
    coded = best_fit.loaded(WORD_BPE, best_fit.LibraryBPE)
    check_pieces(found, [(d, coded.encode(t or "") + b"\x01\0\0\0") for d, t in EDGES], window)
    assert best_fit.pack_best_fit(edges.filter("false"), WORD_BPE).count() == 0


# --- periodic runs ---


def brute_runs(words):
    n, candidates = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                candidates.append((i, j - i + q, q))
            i = j + 1
    smallest = lambda s, size: next(p for p in range(1, size + 1) if words[s : s + size - p] == words[s + p : s + size])
    return sorted(r for r in candidates if smallest(r[0], r[1]) == r[2])


@pytest.mark.parametrize("seed", range(30))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randint(1, 12)):
        unit = [rng.choice([b"a", b"b", b"c", b"d", b"%d" % rng.randrange(40)]) for _ in range(rng.randint(1, rng.choice([2, 5, 9])))]
        words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
    assert periodic_runs.find_runs(words) == brute_runs(words)


def test_runs_of_short_and_uniform_texts():
    for n in range(12):
        assert periodic_runs.find_runs([b"x"] * n) == ([(0, n, 1)] if n >= 6 else [])
    assert periodic_runs.find_runs([b"x"] * 5000) == [(0, 5000, 1)]
    assert periodic_runs.find_runs([b"%d" % (i % 7) for i in range(27)]) == []
    assert periodic_runs.find_runs([b"%d" % (i % 7) for i in range(28)]) == [(0, 28, 7)]
    assert periodic_runs.collapse([b"a", b"b"] * 5 + [b"c"], [(0, 10, 2)]) == [b"a", b"b", b"c"]


def test_runs_query(spark, con, all_texts):
    assert oracle.difference(registry.QUERIES["op12_periodic_runs"](spark, oracle.DATA), con, registry.ORACLES["op12_periodic_runs"]) is None
    found = {r["doc_id"]: r for r in registry.QUERIES["op12_periodic_runs"](spark, oracle.DATA).collect()}
    planted = 0
    for doc, text in sorted(all_texts.items())[:300]:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        row = found[doc]
        assert row["n_runs"] == len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row["start"], row["length"], row["period"]) == best
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted > 10


def test_runs_edges(spark, edges):
    found = periodic_runs.periodic_runs(edges)
    rows = found.collect()
    assert len(rows) == len(EDGES) and found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    by = {r["doc_id"]: r for r in rows}
    assert [tuple(r) for r in by[10]["runs"]] == [(0, 30_000, 1)] and by[10]["collapsed"] == "w"
    assert [tuple(r) for r in by[12]["runs"]] == [(0, 120, 3)] and by[12]["collapsed"] == "same words here"
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["runs"] == [] and by[1]["collapsed"] == ""
    assert by[9]["n_words"] == 9 and by[None]["collapsed"] == "null id three"
    assert len(queries.repeat_words(edges).collect()) == len(EDGES)
    assert periodic_runs.periodic_runs(edges.filter("false")).count() == 0


# --- ranked search ---


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    """docs: (id, text) in any order; items: (item, text)."""
    counted = [(d, Counter(brute_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms, df = len(counted), sum(n for *_, n in counted), Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(brute_terms(text))
    out = set()
    for item, terms in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scores = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            if score := sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t]):
                scores.append((-score, (d is not None, d), d))
        out |= {(item, rank, d, -score) for rank, (score, _, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_numbers_pack_and_unpack():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**31, 2**62, 5], np.int64)
    data, ends = ranked_search.pack_numbers(values)
    assert ranked_search.unpack_numbers(data).tolist() == values.tolist()
    assert ranked_search.unpack_numbers(data[ends[2] : ends[5]]).tolist() == values[3:6].tolist()
    assert ranked_search.unpack_numbers(np.zeros(0, np.uint8)).tolist() == []


@pytest.mark.parametrize("seed", range(20))
def test_merge_loses_no_document(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(rng.randint(1, 30)):
        docs = sorted(rng.sample(range(400), rng.randint(1, rng.choice([3, 50, 390]))))
        scores = [rng.randint(0, rng.choice([1, 5, 100])) for _ in docs]
        lists.append((max(scores), docs, scores))
    total = Counter()
    for _, docs, scores in lists:
        for d, s in zip(docs, scores, strict=True):
            total[d] += s
    wanted = sorted(((s, d) for d, s in total.items() if s), key=lambda x: (-x[0], x[1]))[:10]
    assert sorted(ranked_search.merge_postings(lists, 10), key=lambda x: (-x[0], x[1])) == wanted


def test_search_query(spark, con):
    assert oracle.difference(registry.QUERIES["op13_ranked_search"](spark, oracle.DATA), con, registry.ORACLES["op13_ranked_search"]) is None


@pytest.mark.parametrize("shard_terms,block_terms", [(1, 1), (50, 7), (10**6, 10**6)])
def test_search_in_shards_and_blocks(spark, edges, tmp_path, shard_terms, block_terms):
    items = [(1, "three ONE"), (2, None), (3, "..."), (None, "two, same"), (1, "日本語 w"), (4, "absent"), (5, "x y")]
    path = str(tmp_path / "index")
    ranked_search.build_index(edges.repartition(3), shard_terms=shard_terms).write.parquet(path)
    asked = spark.createDataFrame([(*x, 0.0, 3) for x in items], "item_id long, text string, score double, rank int")
    found = ranked_search.search(spark.read.parquet(path), asked, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in found.collect()} == brute_search(EDGES, items)


def test_search_of_nothing(spark, edges):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked_search.ranked_search(edges.filter("false"), items).count() == 0
    assert ranked_search.ranked_search(edges.filter("text is null"), items).count() == 0
    assert ranked_search.ranked_search(edges, items.filter("false")).count() == 0


def test_search_takes_other_identifiers(spark):
    docs = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), ("c", "blue fox"), (None, "red fox")], "key string, body string")
    items = spark.createDataFrame([("q", "red")], "name string, body string")
    found = ranked_search.ranked_search(docs, items, k=2, id_col="key", item_col="name", text_col="body").collect()
    assert [(r["rank"], r["key"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, None), (2, "a")]


def test_spread_deals_rows_only_where_cores_are_idle(spark, tmp_path):
    from residua.llm.common import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spread(spark.read.parquet(str(tmp_path / "one")))
    assert one.rdd.getNumPartitions() == cores and sorted(r["id"] for r in one.collect()) == list(range(100))
    many = spark.range(100).repartition(4 * cores)
    assert spread(many) is many
    spark.range(100).repartition(2 * cores).write.parquet(str(tmp_path / "some"))
    some = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "some"))
    assert spread(some).count() == 100
    none = spark.range(100).filter("false")
    assert spread(none).count() == 0
