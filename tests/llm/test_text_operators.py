"""Brute-force versions, exact round trips and defined edge cases of the text operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import oracle
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from residua.llm import bpe, compression, cross_entropy, exact_dedup, packing, quality_rules, registry, sharding, simhash
from residua.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, score double, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "One TWO three"), (7, "one two three"), (8, "one two three"),
    (9, "É é ß İ 日本語 👍 \x1c x"), (10, "w " * 30_000), (11, "a" * 20_000), (12, "same words here " * 40), (13, "<|endoftext|> x <|startoftext|>"), (None, "null id"), (4, "one"),
]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, None, "s", None, "clash", 0.0, "clash") for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{oracle.DATA}/documents.parquet")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def all_texts(docs):
    return texts(docs)


def brute_fingerprint(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    a = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            x, y = root(v), root(values[i + 1 + j])
            if x != y:
                parent[max(x, y)] = min(x, y)
    best = {}
    for d, v in prints.items():
        best[root(v)] = min(d, best.get(root(v), d))
    return {d: best[root(v)] for d, v in prints.items()}


def test_simhash_against_brute_force(spark, all_texts):
    found = registry.QUERIES["op1_simhash"](spark, oracle.DATA).collect()
    prints = {d: brute_fingerprint(t) for d, t in all_texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {d: f"{v:016x}" for d, v in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(prints, 3)


@pytest.mark.parametrize("radius", [3, 8])
def test_tiles_lose_no_link(spark, radius):
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:150]:
        for _ in range(3):
            for _ in range(rng.randint(1, radius)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    prints = dict(enumerate(sorted(values)))
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "_rep long, f0 long")
    links = simhash.tile_links(nodes, simhash.segment_counts("f0", 3), simhash.ball(3, radius), radius, tile_rows=40)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints, radius)
    assert links.count() < 20 * len(values)


def test_simhash_edges(spark, edges):
    found = simhash.simhash_components(edges).collect()
    assert len(found) == len(EDGES)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert {by[i][0]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[1][0]["fingerprint"] == "0" * 16
    assert {by[i][0]["component_id"] for i in (6, 7, 8)} == {6}
    assert len(by[4]) == 2 and len(by[None]) == 1
    assert simhash.simhash_components(edges.filter("false")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(100, 100), (None, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(2, 61)} | {i: 100 for i in range(101, 160)}


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_components_of_more_links_than_a_task_takes(spark, monkeypatch, block):
    from residua.llm import components

    monkeypatch.setattr(components, "BLOCK_LINKS", block)
    rng = random.Random(block)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))
    for a, b in links:
        x, y = parent[a], parent[b]
        parent = [min(x, y) if p in (x, y) else p for p in parent]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert found == {i: p for i, p in enumerate(parent) if i != p}


def jaccard(a, b, words=5):
    x, y = set(simhash.shingles(a, words)), set(simhash.shingles(b, words))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_copies_of_the_pipeline(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, n = [], 0
    base_of = {}
    for base in range(40):
        words = rng.choices(vocabulary, k=rng.choice([60, 200, 500]))
        for copy in range(6 if base < 20 else 1):
            mutated = list(words)
            for at in rng.sample(range(len(words)), copy * len(words) // 120):
                mutated[at] = "changed"
            rows.append((n, " ".join(mutated)))
            base_of[n] = base
            n += 1
    passage = " ".join(rng.choices(vocabulary, k=55))
    for _ in range(10):  # clean documents that share a passage
        rows.append((n, passage + " " + " ".join(rng.choices(vocabulary, k=60))))
        base_of[n] = n
        n += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_loser", F.lit("clash"))
    kept = {r["doc_id"] for r in simhash.drop_near_copies(frame).collect()}
    text = dict(rows)
    near = {frozenset((a, b)) for a in text for b in text if a < b and jaccard(text[a], text[b]) >= 0.8}
    assert near
    for a, b in map(sorted, near):
        assert not {a, b} <= kept
    linked = {x for pair in near for x in pair}
    assert set(text) - linked <= kept
    assert {base_of[d] for d in kept} == set(base_of.values())


def star(seed, leaves, words=200, changes=4):
    """A text and copies that are near to it alone: a false candidate for each pair of copies."""
    rng = random.Random(seed)
    centre = [f"w{seed}x{k}" for k in range(words)]
    texts = []
    for leaf in range(leaves):
        mutated = list(centre)
        for at in rng.sample(range(4, words - 4, 5), changes):
            mutated[at] = f"l{leaf}x{at}"
        texts.append(" ".join(mutated))
    return " ".join(centre), texts


def test_near_copies_of_short_texts(spark):
    """Pairs of 4 of 5, 8 of 10 and 12 of 15 shingles: a similarity of exactly 0.8."""
    rows = []
    for n in (4, 8, 12):
        for k in range(1000):
            text = [f"s{n}x{k}x{w}" for w in range(n + 4 + n // 4)]
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text[: n + 4]))]
    assert all(jaccard(rows[k][1], rows[k + 1][1]) == 0.8 for k in range(0, len(rows), 2))
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, len(rows), 2))


def test_a_star_of_near_copies_among_false_candidates(spark):
    centre, leaves = star(1, 999)
    texts = [*leaves[:500], centre, *leaves[500:]]
    assert all(jaccard(centre, x) >= 0.8 for x in leaves) and jaccard(leaves[0], leaves[1]) < 0.8
    kept = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]


def brute_near(texts, similarity=0.8):
    """The smallest place that a chain of similar texts leads to, for each."""
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    parent = list(range(len(texts)))
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                links += 1
                x, y = parent[i], parent[j]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    return parent, links


def test_links_inside_and_between_blocks(spark):
    texts = []
    for family in range(4):
        centre, leaves = star(family, 25, changes=3 + family)
        texts += [*leaves[:20], centre, *leaves[20:]]
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts))
    parent, _ = brute_near(texts)
    groups = spark.createDataFrame([(i, 0) for i, _ in rows if i], "node long, component long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4_000, 10_000, 1_000_000):
        found = {r["node"]: r["component"] for r in simhash.verified_components(docs, groups, "doc_id", "text", 5, 0.8, block=block).collect()}
        assert [found.get(i, i) for i, _ in rows] == parent


def test_families_around_the_similarity_give_the_components_of_brute_force(spark):
    """150 variants of a text with 4 or 5 of 300 words changed: most pairs lie on either side of 0.8."""
    texts, rng = [], random.Random(7)
    for family in range(3):
        centre = [f"f{family}w{k}" for k in range(300)]
        for _ in range(150):
            mutated = list(centre)
            for at in rng.sample(range(300), rng.choice([4, 5, 6, 7])):
                mutated[at] = f"x{rng.random()}"
            texts.append(" ".join(mutated))
    rng.shuffle(texts)
    parent, links = brute_near(texts)
    assert links > 100
    found = {r["node"]: r["component"] for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == parent


def test_fingerprints_find_pairs_at_the_similarity():
    """Of 4,000 pairs of random sets at exactly 0.8, of 80 to 400 shingles, at most one lies beyond the radii."""
    rng, missed = np.random.default_rng(1), 0
    for k in range(4000):
        n = (80, 100, 200, 400)[k % 4]
        union = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(k % 2)
        cut = n // 10 if k % 3 else 0
        a, b = (np.array(simhash.fingerprint(x, 4)).view(np.uint64) for x in (union[: n - cut], union[cut or n // 5 :]))
        bits = np.bitwise_count(a ^ b)
        missed += int(bits[:2].sum()) > simhash.COARSE_RADIUS or int(bits.sum()) > simhash.NEAR_RADIUS
    assert missed <= 1


def test_near_copies_need_integer_identifiers(spark):
    with pytest.raises(TypeError, match="integer"):
        simhash.near_components(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    found = simhash.simhash_components(spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "one two three"), (None, "x")], "doc_id string, text string")).collect()
    assert sorted(str(r["component_id"]) for r in found) == ["None", "a", "a", "a"]


def brute_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_against_brute_force(spark, all_texts):
    found = registry.QUERIES["op2_quality_rules"](spark, oracle.DATA).collect()
    assert {r["doc_id"]: tuple(r[c] for c in RULE_COLUMNS) for r in found} == {d: brute_rules(t) for d, t in all_texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_rules_edges(edges):
    found = quality_rules.quality_rules(edges).collect()
    wanted = sorted((brute_rules(t) for _, t in EDGES), key=str)
    assert sorted((tuple(r[c] for c in RULE_COLUMNS) for r in found), key=str) == wanted
    assert quality_rules.quality_rules(edges.filter("false")).count() == 0


def test_rules_keep_clean_documents_and_drop_marked_ones(spark):
    found = registry.QUERIES["op2_quality_rules"](spark, oracle.DATA).join(spark.read.parquet(f"{oracle.DATA}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["s"] for r in found.filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("s")).collect()}
    assert share[1] > 0.98 and share[0] < 0.05


def test_cleaning_takes_lines_out(spark):
    text = "This is a fine line of text that ends well.\nHome | News | About | Contact\nAll rights reserved.\nAnother good line is here, with words enough to stay for the reader."
    found = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found["kept"] and found["clean_text"].count("\n") == 1


LINES = [
    "one two three four five six seven eight nine ten eleven twelve\r\nA line that ends well.\r\n", "\tone two three four five six seven eight nine ten eleven twelve\t\nA line.", "Alle Rechte vorbehalten.\nTous Droits Réservés.\nA line.",
    "https://a.example www.b.example see\nA line.", "http://a.example is a link that a line of words may hold.", " | a | b |\r\nA::b::c\nA line.", "a a a a a b b b b c c c c d d.\nA line.", "LICENſED under it\nPolítica de privacidad\nA line.", "\r\n\r\n", "\x0b\x0c",
]


def test_rules_of_odd_lines_agree_with_sql(spark):
    rows = [(i, t + "\n" + "A long line of good words that ends as it should, with a full stop and no fault at all.") for i, t in enumerate(LINES)] + [(90 + i, t) for i, t in enumerate(LINES)] + [(99, None), (1, LINES[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    found = quality_rules.quality_rules(frame)
    assert oracle.difference(found.select("doc_id", *RULE_COLUMNS, "kept", "kept_chars"), con, registry.ORACLES["op2_quality_rules"]) is None
    good = {r["doc_id"]: r["clean_text"].split("\n")[0] for r in found.collect()}
    assert good[0] == LINES[0].split("\n")[0] and good[1] == LINES[1].split("\n")[0] and good[4] == LINES[4]
    assert [good[i] for i in (2, 3, 5)] == ["A line."] * 3


def test_cleaning_runs_the_rules_once_and_keeps_columns(spark, edges):
    frame = edges.withColumn("_row", F.lit("clash")).withColumn("_words", F.lit("clash"))
    cleaned = quality_rules.clean_documents(frame, length_col="n_chars")
    assert cleaned.columns == frame.columns and all(r["_row"] == r["_words"] == r["kept"] == "clash" for r in cleaned.collect())
    assert quality_rules.clean_documents(frame.filter("false")).count() == 0
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("all rights") <= 1 and plan.count("RLIKE") <= 4
    kept = quality_rules.quality_rules(frame).filter("kept").count()
    assert cleaned.count() == kept


def test_classifier_is_right_on_held_out_rows(spark):
    found = registry.QUERIES["op3_quality_classifier"](spark, oracle.DATA)
    assert {r["doc_id"]: r["held_out"] for r in found.collect()} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in range(found.count())}
    scored = found.join(spark.read.parquet(f"{oracle.DATA}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.95
    assert (scored.loc[scored["quality"] == 0, "predicted"] == 0).mean() > 0.8
    assert scored["score"].between(0, 1).all()


def test_classifier_against_brute_force(spark, docs, all_texts):
    """Differences by the library, one call a block; the calibration is the optimum of its penalised likelihood."""
    import zstandard

    labels = spark.read.parquet(f"{oracle.DATA}/labels.parquet")
    model = compression.fit(docs, labels)
    found = {r["doc_id"]: r for r in compression.classify(docs, model).collect()}
    sizes = []
    for content in (model.good, model.bad):
        one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append({d: sum(len(one.compress(t.encode()[i : i + 1024])) for i in range(0, len(t.encode()), 1024)) for d, t in all_texts.items()})
    for d, t in all_texts.items():
        wanted = (sizes[1][d] - sizes[0][d]) / max(1, len(t.encode()))
        assert found[d]["difference"] == pytest.approx(wanted, abs=1e-12)
        assert found[d]["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * wanted + model.intercept))), abs=1e-9)

    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x - 0.5)))).astype(int)
    slope, intercept = compression.calibrate(x, y)

    def cost(w, b):
        z = w * x + b
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (w * x.std()) ** 2 + 0.005 * (b + w * x.mean()) ** 2

    best = cost(slope, intercept)
    assert all(cost(slope + dw, intercept + db) > best for dw in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01) if dw or db)


def test_classifier_edges(spark, edges):
    labels = spark.createDataFrame([(6, 1), (12, 0), (None, 1), (3, None), (6, 0)], "doc_id long, quality int")
    model = compression.fit(edges, labels)
    found = compression.classify(edges, model).collect()
    assert len(found) == len(EDGES) and all(0 <= r["score"] <= 1 for r in found)
    assert compression.keep_good(edges, model, threshold=0.0).columns == edges.columns
    assert compression.classify(edges.filter("false"), compression.fit(edges, labels.filter("false"))).count() == 0


def check_shards(found, shards, groups):
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes[s] for s in range(shards)) - min(sizes[s] for s in range(shards)) <= 1
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    held = {}
    for r in found:
        held.setdefault(groups[r["doc_id"]], set()).add(r["shard"])
    return held


def test_sharding(spark, all_texts):
    found = registry.QUERIES["op4_sharding"](spark, oracle.DATA).collect()
    held = check_shards(found, 40, all_texts)
    for r in found:
        raw = all_texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert sum(len(x) > 1 for x in held.values()) == 0


def test_sharding_of_hot_groups_and_edges(spark, edges):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 7 == 0 else f"t{i}") for i in range(400)]
    found = sharding.balanced_label_propagation(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=10).collect()
    held = check_shards(found, 10, dict(rows))
    assert len(held["hot"]) <= 5 and len(held["warm"]) <= 2
    found = sharding.balanced_label_propagation(edges, shards=4).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in EDGES)
    check_shards(found, 4, {i: i for i, _ in EDGES})
    assert sharding.balanced_label_propagation(edges.filter("false")).count() == 0


@pytest.mark.parametrize(("sizes", "pieces"), [([2] * 400, 400), ([2] * 396 + [1] * 8, 404), ([53] * 16 + [1] * 64, 86), ([300, 90, 90, 80, 20, 20], 13)])
def test_sharding_keeps_copies_together_where_little_room_is_free(spark, sizes, pieces):
    texts = dict(enumerate(f"t{k}" for k, n in enumerate(sizes) for _ in range(n)))
    found = sharding.balanced_label_propagation(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shards=10).collect()
    assert sum(map(len, check_shards(found, 10, texts).values())) == pieces


def fewest_pieces(sizes, quotas):
    """The fewest pieces of texts over shards, by trying all ways to fill one shard after the other."""
    from functools import cache

    @cache
    def rest(left, k):
        if k == len(quotas):
            return 0 if not any(left) else 10**9
        best = 10**9

        def choose(i, room, taken, pieces):
            nonlocal best
            if i == len(left):
                if room == 0:
                    best = min(best, pieces + rest(tuple(sorted((a - b for a, b in zip(left, taken, strict=True) if a > b), reverse=True)), k + 1))
                return
            for n in range(min(left[i], room) + 1):
                choose(i + 1, room - n, [*taken, n], pieces + (n > 0))

        choose(0, quotas[k], [], 0)
        return best

    return rest(tuple(sorted(sizes, reverse=True)), 0)


@pytest.mark.parametrize("sizes", [[3, 3, 3, 1, 1, 1], [4, 3, 2, 2, 1], [6, 2, 2, 1, 1], [5, 5, 2], [2, 2, 2, 2, 2, 2]])
def test_sharding_cuts_little_more_than_the_best_plan(spark, sizes):
    texts = dict(enumerate(f"t{k}" for k, n in enumerate(sizes) for _ in range(n)))
    found = sharding.balanced_label_propagation(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shards=3).collect()
    assert sum(map(len, check_shards(found, 3, texts).values())) <= fewest_pieces(sizes, (4, 4, 4)) + 1


def test_sharding_of_rows_that_are_alike(spark):
    frame = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("text"))
    found = sharding.balanced_label_propagation(frame, shards=6).collect()
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == 900 and set(sizes.values()) == {150}
    assert len({(r["shard"], r["slot"]) for r in found}) == 900
    assert len({r["shard"] for r in found if r["group_rows"] == 450}) == 3


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, name):
    assert oracle.difference(registry.QUERIES[name](spark, oracle.DATA), oracle.connection(), registry.ORACLES[name]) is None


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_edges(spark, edges, keep):
    found = exact_dedup.content_sort_dedup(edges, keep=keep, heavy_cost=3000).collect()
    assert len(found) == len(EDGES)
    groups = {}
    for i, t in EDGES:
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), []).append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    pick = min if keep == "smallest" else max
    for r in found:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (pick(i for i in ids if i is not None) if ids != [None] else None)
    assert sum(r["kept"] for r in found) == len(by)
    assert exact_dedup.content_sort_dedup(edges.filter("false")).count() == 0
    assert exact_dedup.drop_copies(edges).columns == edges.columns


def test_exact_dedup_of_many_copies(spark):
    """A third of the rows are one text: its cell is cut over tasks, and its runs are joined by their texts."""
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot Text").otherwise(F.col("id").cast("string")).alias("text")).repartition(6)
    for heavy in (100_000, 1 << 30):
        found = exact_dedup.content_sort_dedup(frame, keep="largest", heavy_cost=heavy).filter("kept").collect()
        assert len(found) == 2001
        assert next(r["keep_id"] for r in found if r["group_size"] == 1000) == 2997
    runs = exact_dedup.sorted_runs(frame, "doc_id", "text", "largest", 100_000).filter("_head").collect()
    hot = [r for r in runs if r["_cut"]]
    assert len(hot) > 10 and max(r["_run_size"] for r in hot) < 200
    assert len(runs) - len(hot) == 2000


def test_texts_of_one_cell_are_told_apart(spark):
    """Equal start, length and middle, with and without cuts, and a hash that says that all are equal."""
    rows = [(i, "s" * 20 + f"{i % 7:05d}" + "m" * 60 + f"{i % 3:05d}" + "e" * 20) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for heavy in (20_000, 1 << 30):
        found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.content_sort_dedup(frame, heavy_cost=heavy).collect()}
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        assert found == {i: (min(groups[t]), len(groups[t])) for i, t in rows}


def test_no_hash_decides_which_texts_are_equal(spark, docs, monkeypatch):
    wanted = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.content_sort_dedup(docs).collect()}
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("same"))
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *columns: F.lit(1).cast("bigint"))
    for heavy in (1 << 20, 1 << 40):
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.content_sort_dedup(docs, heavy_cost=heavy).collect()} == wanted
    runs = exact_dedup.sorted_runs(docs, "doc_id", "text", "smallest", 1 << 40)
    assert runs.filter("_head").count() == len({k for _, k, _, _ in wanted})


def library(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


ODD = [t or "" for _, t in EDGES] + [
    "<|endoftext|>", "x<|endoftext", " a", "a ", "a\n b \nc", "a\n\nb  c\t d\r\n", "it's WE'LL 'S", "ΣΑΣ ς ﬁ e\u0301 Å", "1234 ½²Ⅷ٣", "don’t “q” … –", "abc" * 500, "\x00\x7f", "a\x85b\xa0c",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kind", [bpe.RankArrayBPE, bpe.LibraryBPE])
def test_bpe_equals_the_library(name, kind, all_texts):
    mine, theirs = kind(public_tokenizers.path(name)), library(name)
    rng = random.Random(1)
    pools = [(32, 127), (0xA0, 0x250), (0x300, 0x370), (0x2000, 0x2100), (0x4E00, 0x4F00), (0x1F600, 0x1F640), (9, 14)]
    noise = ["".join(chr(rng.randrange(*rng.choice(pools))) for _ in range(60)) for _ in range(200)]
    for text in [*ODD, *noise, *list(all_texts.values())[:100]]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        packed = mine.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert mine.decode(packed) == theirs.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike():
    mine = bpe.RankArrayBPE(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for _ in range(50):
        ids = [mine.inner[ord(rng.choice("theraniongs"))] for _ in range(rng.randint(1, 300))]
        assert mine.merge(ids) == mine.merge_long(ids)


def test_bpe_query(spark, all_texts):
    theirs = library("word_bpe_49k.json")
    for r in registry.QUERIES["op6_bpe"](spark, oracle.DATA).collect():
        ids = theirs.encode(all_texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark, edges):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.round_trip(edges, path).count() == len(EDGES)
    assert bpe.encode_documents(edges.filter("doc_id = 1"), path).first()["ids"] == b""
    assert bpe.encode_documents(edges.filter("false"), path).count() == 0


def check_packing(rows, ids_of, window=1024):
    """Every id in one piece; sequences gapless; returns the share of padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, own in pieces.items():
        wanted, at = ids_of[doc], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(wanted)
            assert r["ids_crc32"] == zlib.crc32(np.array(wanted[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(wanted)
    assert pieces.keys() == ids_of.keys()
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / (total + padding)


def test_packing_query(spark, all_texts):
    theirs = library("byte_bpe_50k.json")
    ids = {d: [*theirs.encode(t, add_special_tokens=False).ids, 0] for d, t in all_texts.items()}
    assert check_packing(registry.QUERIES["op7_packing"](spark, oracle.DATA).collect(), ids) < 0.01


def test_packing_edges(spark, edges):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = edges.dropDuplicates(["doc_id"])
    theirs = library("byte_bpe_50k.json")
    ids = {r["doc_id"]: [*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in frame.collect()}
    found = packing.pack_documents(frame, path, max_open=2).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(found, ids)
    assert packing.pack_documents(edges, path).agg(F.sum("length")).first()[0] == packing.pack_documents(edges, path).filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert packing.pack_documents(edges.filter("false"), path).count() == 0


def test_the_level_minimises_the_sum_of_squares():
    rng = random.Random(5)
    packer = packing.SumOfSquares(32, 10_000)
    for n in range(500):
        size = rng.randint(1, 31)
        counts = packer.counts.copy()

        def after(level, size=size, counts=counts):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c**2).sum())

        level = packer.level_for(size)
        usable = [h for h in range(33 - size) if h == 0 or counts[h]]
        assert after(level) == min(map(after, usable))
        packer.add((n, 0, size, bytes(4 * size), size))
        assert packer.n_open == packer.counts.sum() == sum(map(len, packer.open.values()))


class BruteModel:
    """A bigram model with its own counting: p over the vocabulary after each history."""

    def __init__(self, texts, vocabulary, scale=1.0):
        self.single, self.pair, self.after, self.vocabulary = Counter(), Counter(), Counter(), vocabulary
        for words in texts:
            for u, w in zip([None, *words], words):  # noqa: B905
                self.single[w] += scale
                self.pair[u, w] += scale
                self.after[u] += scale

    def p(self, u, w):
        single = (self.single[w] + cross_entropy.WORD_PRIOR / len(self.vocabulary)) / (sum(self.single.values()) + cross_entropy.WORD_PRIOR)
        return (self.pair[u, w] + cross_entropy.PAIR_PRIOR * single) / (self.after[u] + cross_entropy.PAIR_PRIOR)

    def loss(self, words):
        return -sum(np.log(self.p(u, w)) for u, w in zip([None, *words], words)) / len(words) if words else 0.0  # noqa: B905


SMALL = ["a b a b c", "a b", "a", "", "c c c a b a", "b a b a d", "d", "a b a b c", None, "e f g a b", "a a a a"]


@pytest.mark.parametrize(("chunk_tokens", "bucket_tokens", "fan"), [(1 << 20, 1 << 21, 256), (3, 1, 2), (2, 3, 3), (6, 2, 256)])
def test_cross_entropy_against_brute_force(spark, chunk_tokens, bucket_tokens, fan):
    frame = spark.createDataFrame(list(enumerate(SMALL)), "doc_id long, text string").repartition(2)
    wanted = {0, 1, 4, 5}
    found = {r["doc_id"]: r for r in cross_entropy.cross_entropy_difference(frame, frame.filter(F.col("doc_id").isin(list(wanted))), chunk_tokens=chunk_tokens, bucket_tokens=bucket_tokens, fan=fan).collect()}
    tokens = {i: (t or "").split() for i, t in enumerate(SMALL)}
    vocabulary = {w for words in tokens.values() for w in words}
    share = sum(len(tokens[d]) for d in wanted) / sum(map(len, tokens.values()))
    for d, words in tokens.items():
        others = [t for k, t in tokens.items() if k != d]
        models = BruteModel(others, vocabulary), BruteModel([t for k, t in tokens.items() if k != d and k in wanted], vocabulary), BruteModel(others, vocabulary, share)
        background, target, matched = (m.loss(words) for m in models)
        for model in models:
            for u in [None, *vocabulary]:
                assert sum(model.p(u, w) for w in vocabulary) == pytest.approx(1)
        assert found[d]["n_tokens"] == len(words)
        assert (found[d]["background_loss"], found[d]["target_loss"], found[d]["matched_loss"]) == pytest.approx((background, target, matched), abs=1e-9)
        assert found[d]["score"] == pytest.approx(target - matched, abs=1e-9)


def test_cross_entropy_is_the_same_in_small_chunks_and_buckets(spark, docs):
    good = spark.read.parquet(f"{oracle.DATA}/labels.parquet").filter("quality = 1")
    whole = cross_entropy.cross_entropy_difference(docs, good).toPandas().sort_values("doc_id", ignore_index=True)
    for fan in (256, 5):
        cut = cross_entropy.cross_entropy_difference(docs, good, chunk_tokens=30_000, bucket_tokens=20_000, fan=fan).toPandas().sort_values("doc_id", ignore_index=True)
        pd.testing.assert_frame_equal(whole, cut)


def test_cross_entropy_tells_target_from_the_rest(spark, docs):
    """Over held-out documents: their labels are not among the target's."""
    labels = spark.read.parquet(f"{oracle.DATA}/labels.parquet")
    found = cross_entropy.cross_entropy_difference(docs, labels.filter("quality = 1 and doc_id % 2 = 0"))
    scored = found.join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = (scored.loc[scored["quality"] == k, "score"].to_numpy() for k in (1, 0))
    assert np.mean(good[:, None] < bad[None]) > 0.8


def test_a_document_does_not_help_itself(spark):
    """Twins raise each other's probability; a text that occurs once gets nothing from its own counts."""
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(words, k=50))) for i in range(100)]
    rows += [(200, rows[0][1])]
    found = {r["doc_id"]: r["background_loss"] for r in cross_entropy.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5,)], "doc_id long")).collect()}
    assert max(found[0], found[200]) < min(v for d, v in found.items() if d not in (0, 200)) - 1


def test_cross_entropy_edges(spark, edges):
    found = cross_entropy.cross_entropy_difference(edges, spark.createDataFrame([(6,), (None,), (6,)], "doc_id long")).collect()
    assert len(found) == len(EDGES)
    assert all(r["score"] == 0 and r["n_tokens"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert cross_entropy.cross_entropy_difference(edges.filter("false"), edges.filter("false")).count() == 0


def test_duckdb_is_there():
    assert duckdb.sql("SELECT 1").fetchall() == [(1,)]


def test_classifier_collects_one_text_per_identifier(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i} {c}") for i in range(60) for c in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen, train = [], compression.train_dictionary
    monkeypatch.setattr(compression, "train_dictionary", lambda texts: seen.append(len(texts)) or train(texts))
    model = compression.fit(docs, labels, train_rows=5)
    assert seen == [5, 5] and model == compression.fit(docs.repartition(7), labels, train_rows=5)


def test_near_components_of_a_whole_table_equal_brute_force(spark, docs, all_texts):
    """All links at 0.8 or more, found by the rarest shingles of each text, which miss none."""
    sets = {d: frozenset(simhash.shingles(t, 5)) for d, t in all_texts.items()}
    often = Counter(s for own in sets.values() for s in own)
    filed, parent, long_links = {}, {d: d for d in sets}, 0

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d in sorted(sets, key=lambda d: len(sets[d])):
        own = sets[d]
        first = sorted(own, key=lambda s: (often[s], s))[: len(own) - -(-4 * len(own) // 5) + 1]
        for other in {o for s in first for o in filed.get(s, ())}:
            common = len(own & sets[other])
            if own and 5 * common >= 4 * (len(own) + len(sets[other]) - common):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
                long_links += min(len(own), len(sets[other])) > simhash.SHORT_SHINGLES
        for s in first:
            filed.setdefault(s, []).append(d)
    found = {r["node"]: r["component"] for r in simhash.near_components(docs).collect()}
    assert {d: found.get(d, d) for d in sets} == {d: root(d) for d in sets}
    assert long_links > 50


def test_added_tokens_of_any_look(tmp_path):
    import json

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec["added_tokens"] += [{"id": 50257, "content": "[CLS]", **plain}, {"id": 50258, "content": "</s>", **plain}, {"id": 50259, "content": "§", **plain}]
    path = tmp_path / "more.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own, library = bpe.RankArrayBPE(str(path)), Tokenizer.from_file(str(path))
    for text in ("a [CLS]b</s>", "[CLS][CLS]", "x § y§", "<|endoftext|>[cls] </s", "none of them"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    spec["added_tokens"][1]["lstrip"] = True
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="lstrip"):
        bpe.RankArrayBPE(str(path))
