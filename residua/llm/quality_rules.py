"""Quality rules, line first.

Each line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed,
and a document that loses too much of its text is rejected. Only DataFrame functions are used, all
of them inside one row, so there is no shuffle and no hot key. Each document is judged once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_REGEX, let, whole

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected when its clean lines hold less than this share of its characters.
MIN_KEPT_SHARE = 0.5

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"

#: Line rules. A sentence ends with this, closing quotes or brackets allowed after it.
SENTENCE_END = r"[.!?…。！？:;]['\"”’»)\]]*([\x20\x09-\x0D]|$)"
#: Two of these separators make a line navigation.
SEPARATORS = ("|", "»", "›", "•", "·", "::", ">>")
SEPARATOR = "(?:[|»›•·]|::|>>)"
NAVIGATION = SEPARATOR + r"[^\n]*" + SEPARATOR
#: Boilerplate by language; A-Z count as a-z.
PHRASES = {
    "en": (
        r"licen[cs]ed under\b", r"all rights reserved\b", r"terms of (use|service)\b", r"privacy policy\b", r"cookie policy\b", r"accept cookies\b", r"enable javascript\b", r"click here\b",
        r"subscribe now\b", r"sign up for\b", r"share this\b", r"copyright \d{4}\b", r"lorem ipsum\b",
    ),
    "de": (
        r"alle rechte vorbehalten\b", r"cookies (akzeptieren|zulassen)\b", r"hier klicken\b", r"newsletter abonnieren\b", r"allgemeine gesch(ä|ae)ftsbedingungen\b", r"javascript aktivieren\b",
    ),
    "fr": (r"tous droits r[eéÉ]serv", r"politique de confidentialit", r"accepter les cookies\b", r"cliquez ici\b", r"mentions l[eéÉ]gales\b", r"activer javascript\b"),
    "es": (r"todos los derechos reservados\b", r"pol[iíÍ]tica de privacidad\b", r"aceptar (las )?cookies\b", r"haga clic aqu", r"aviso legal\b", r"activar javascript\b"),
}


def _by_first_letter(patterns: list[str]) -> str:
    """One alternation in which a letter is looked at once, whatever the number of phrases."""
    letters = sorted({p[0] for p in patterns})
    return r"\b(" + "|".join(f"{c}({'|'.join(p[1:] for p in patterns if p[0] == c)})" for c in letters) + ")"


BOILERPLATE = _by_first_letter([p for group in PHRASES.values() for p in group])
#: A line of which at least half the words are links is boilerplate in any language.
LINK = r"(https?://|www\.)"
MAX_LINK_SHARE = 0.5
#: Words that carry symbols, and shouting.
NOISY_WORD = r"([#*$%&<>=~^_]{2,}|!{2,})"
MAX_NOISY_SHARE = 0.2
#: Words that are followed by themselves.
MAX_ECHO_SHARE = 0.3
#: A short line may lack any sentence end (a heading), a longer one may not.
HEADING_WORDS = 12


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_REGEX), "")


def _shifted(hashes: Column, by: int) -> Column:
    """Hash each element with the one `by` places on."""
    return F.zip_with(hashes, F.slice(hashes, by + 1, 2_000_000_000), lambda a, b: F.xxhash64(a, b))


def window_hashes(single: Column) -> Column:
    """A 64-bit hash of each window of eight words from the words' hashes, by doubling: 1, 2, 4, 8 words."""
    count = F.greatest(F.size(single) - (WINDOW_WORDS - 1), F.lit(0))
    eight = let(_shifted(single, 1), lambda two: let(_shifted(two, 2), lambda four: _shifted(four, 4)))
    return F.slice(eight, 1, count)


def repeated_words(hashes: Column) -> Column:
    """Words inside windows found twice or more: the length of the union of those windows."""

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, 2_000_000_000), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    def twins(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def slow(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(ordered, twins), covered)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(slow(hashes))


def may_navigate(text: Column) -> Column:
    """Whether the text holds a separator at all: a quick search that spares most texts a slow pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in SEPARATORS])


def line_fails(line: Column, navigates: Column) -> Column:
    """Whether a line with words breaks a rule. navigates: whether its text may hold navigation."""

    def judged(words: Column) -> Column:
        n_words = F.size(words)
        echoes = F.size(F.filter(words, lambda w, i: F.get(words, i + 1) == w))
        links = F.when(F.contains(line, F.lit("http")) | F.contains(line, F.lit("www.")), F.regexp_count(line, F.lit(LINK))).otherwise(0)
        return (
            ((n_words > HEADING_WORDS) & ~line.rlike(SENTENCE_END))
            | ((n_words > HEADING_WORDS) & (echoes > n_words * MAX_ECHO_SHARE))
            | (F.regexp_count(line, F.lit(NOISY_WORD)) > n_words * MAX_NOISY_SHARE)
            | ((links > 0) & (links >= n_words * MAX_LINK_SHARE))
        )

    return (navigates & line.rlike(NAVIGATION)) | line.rlike("(?i)" + BOILERPLATE) | let(words_of(line), judged)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "kept_chars", "clean_text", "base_failed", "kept")


def _judged(docs: DataFrame, text_col: str, min_kept_share: float) -> DataFrame:
    """The rows as a struct `_row` beside their measures, so that no name of theirs can clash."""
    chars = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda total, x: total + F.length(x))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), whole(text_col).alias("_text"))
    rows = rows.withColumns({"_words": words_of(F.col("_text")), "_navigates": may_navigate(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    rows = rows.withColumn("_single", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumns({"_windows": window_hashes(F.col("_single")), "_good": F.filter("_lines", lambda x: ~line_fails(x, F.col("_navigates")))})
    measured = rows.select(
        "_row",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit("[" + SYMBOLS + "]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
        chars(F.col("_lines")).alias("line_chars"),
        chars(F.col("_good")).alias("kept_chars"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= F.col("line_chars") * min_kept_share))


def quality_rules(docs: DataFrame, text_col: str = "text", min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, kept_chars, clean_text, base_failed, kept.

    The new columns replace columns of the same names. A null or empty text has no words and so is
    base_failed. A line without words is neither kept nor counted as lost. Every row keeps its own
    result; repeated rows stay. `clean_text` is the text without the removed lines.
    """
    judged = _judged(docs, text_col, min_kept_share)
    return judged.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in MEASURES), *MEASURES)


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The kept documents, with their columns, and the clean text in place of the text.

    `length_col` names a column that follows the text's length. Rows come from a generator, below
    which no filter is pushed, so the rules run once for each document.
    """
    judged = _judged(docs, text_col, min_kept_share)
    new = {text_col: F.col("clean_text")} | ({length_col: F.length("clean_text").cast(docs.schema[length_col].dataType)} if length_col else {})
    row = F.struct(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
    return judged.select(F.inline(F.when(F.col("kept"), F.array(row))))
