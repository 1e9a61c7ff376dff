"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression, packing, quality_rules as rules, url_filters, warc
from .common import SPACE_REGEX, WORD_REGEX, let, limit_batches, scratch_path, spread, stored, table as read_table, whole
from .best_fit import pack_best_fit
from .cross_entropy import cross_entropy_difference
from .exact_dedup import content_sort_dedup
from .periodic_runs import periodic_runs
from .quality_rules import quality_rules
from .ranked_search import BREAKS, ranked_search
from .sharding import balanced_label_propagation
from .simhash import simhash_components
from .url_filters import filter_urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    limit_batches(spark)
    return read_table(spark, folder, name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(spread(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.classify(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_label_propagation(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = scratch_path(spark, "archives"), table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    # Read once: what is kept are digests, and the blocks of records that lie in segments.
    records = stored(warc.read_records(spark, path, payloads=False, ids=warc.id_kind(pages)), "records")
    read = stored(warc.reassemble(records, payloads=False), "reassembled")
    sizes = read.filter("kind = 'response'").groupBy(F.col("page").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    joined = read.join(sizes, (F.col("kind") == "revisit") & (F.col("refers_to") == F.col("_page")) & (F.col("stated") == F.col("_digest")), "left")
    return joined.select(
        F.col("page").alias("page_id"),
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "stated").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
        "problem",
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("candidates")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_best_fit(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def repeat_words(docs: DataFrame) -> DataFrame:
    """The documents, with the words of those whose crc32(doc_id) ends in 0 repeated from a place on, as op12 asks."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(words):
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, place(i).cast("int"))))

    words = F.regexp_extract_all("text", F.lit(WORD_REGEX), F.lit(0))
    text = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(whole()).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeat_words(spread(table(spark, sf_dir, "documents"))))
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("_most", F.get(longest, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "_most.start",
        "_most.length",
        "_most.period",
        F.expr("1000 * _most.length div _most.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP5_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = _quoted(SPACE_REGEX)

OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), {_SPACES}), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + {rules.WINDOW_WORDS - 1}], ' ') AS h FROM w, unnest(range(1, len(words) - {rules.WINDOW_WORDS - 2})) AS r(i)
), twins AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
), covered AS (
  SELECT doc_id, sum(least({rules.WINDOW_WORDS}, coalesce(after - i, {rules.WINDOW_WORDS})))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twins) GROUP BY doc_id
), cut AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(line, {_SPACES}), lambda x: x <> '') AS words, translate(line, {_LETTERS}) AS low
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, {_quoted("[^" + SPACE_REGEX[1:-2] + "]")})
), judged AS (
  SELECT doc_id, line, len(words) AS n,
         len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS echoes,
         len(regexp_extract_all(line, {_quoted(rules.NOISY_WORD)})) AS noisy, len(regexp_extract_all(line, {_quoted(rules.LINK)})) AS links, low
  FROM cut
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dups, sum(length(line)) AS chars,
         coalesce(sum(length(line)) FILTER (NOT (
           n > {rules.HEADING_WORDS} AND NOT regexp_matches(line, {_quoted(rules.SENTENCE_END)}) OR regexp_matches(line, {_quoted(rules.NAVIGATION)})
           OR regexp_matches(low, {_quoted(rules.BOILERPLATE)}) OR links >= n * {rules.MAX_LINK_SHARE} AND links > 0 OR noisy > n * {rules.MAX_NOISY_SHARE} OR n > {rules.HEADING_WORDS} AND echoes > n * {rules.MAX_ECHO_SHARE})), 0) AS kept_chars
  FROM judged GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, {_quoted("[" + rules.SYMBOLS + "]")}))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT base_failed AND kept_chars >= chars * {rules.MIN_KEPT_SHARE} AS kept, kept_chars
FROM base
"""

OP9_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, octet_length(encode(t)) AS n, CASE WHEN n >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY t) END AS first FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, NULL::VARCHAR AS problem
FROM p
"""

_HOST_RULES = ", ".join(f"({_quoted(action)}, {_quoted(host)}, {_quoted(path)})" for action, host, path in url_filters.HOST_RULES)
_LISTED = {action: " OR ".join(f"regexp_matches(low, {_quoted(x.pattern.replace(url_filters.END, chr(92) + 'z'))})" for x in url_filters.default_rules() if not x.ranked and x.action == action) for action in ("block", "allow")}

OP10_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LETTERS}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), r AS (
  SELECT * FROM (VALUES {_HOST_RULES}) AS r(action, h, start)
), fits AS (
  SELECT page_id, arg_max(h || start, length(h || start)) AS rule, arg_max(action, length(h || start)) AS action
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, rule, coalesce(action, CASE WHEN ({_LISTED["block"]}) AND NOT ({_LISTED["allow"]}) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, translate(host || path, {_LETTERS}) AS low FROM u) AS u LEFT JOIN fits USING (page_id)
"""

# The sum of bytes that crc32 makes, bit by bit; 3988292384 is its fixed polynomial.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda x, c: list_reduce(list_prepend(xor(x, c), [0::BIGINT for b in range(8)]), lambda y, b: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"

OP12_SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_SPACES}), lambda x: x <> '') AS words, len(words) AS n, {_CRC32} AS h, h // 10 AS g,
         CASE WHEN n > 0 THEN g % n END AS a, 1 + (n - a) // (3 + g % 8) AS p
  FROM documents
), repeated AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words FROM w
), placed AS (
  SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM repeated
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM placed AS x JOIN placed AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS s, min(i) + count(*) + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches AS r WHERE NOT EXISTS (SELECT 1 FROM stretches AS d WHERE d.doc_id = r.doc_id AND d.q < r.q AND r.q % d.q = 0 AND d.s <= r.s AND r.e <= d.e)
), summed AS (
  SELECT doc_id, count(*) AS n_runs, arg_max((s, e - s, q), (e - s, -s, -q)) AS most, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
  FROM placed AS x WHERE NOT EXISTS (SELECT 1 FROM runs AS r WHERE r.doc_id = x.doc_id AND r.s + r.q <= x.i AND x.i < r.e) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, most[1] AS start, most[2] AS length, most[3] AS period, 1000 * most[2] // most[3] AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TERM = _quoted("[^" + BREAKS[1:-2] + "]+")

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_TERM}) AS terms, len(terms) AS n FROM documents
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d WHERE n > 0
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, docs
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), {_TERM})) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + 90 * n * docs // totals.terms))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
