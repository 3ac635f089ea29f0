"""Quality rules by distribution divergence, in SQL functions only.

A document's histograms of character classes and of its language's common words are compared with references: the
median share of every bin over all documents of the language. The Jensen-Shannon distance to either may not be over a
limit, in documents long enough for it to mean something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zoneloom.session import cut_lineage

WINDOW = 8  # words that repeat together
LEAST_WORDS = 20
REPEATED_PERCENT = 30
DIVERGENCE_WORDS = 100  # shorter documents are not judged by divergence, nor do they count for the references
CHARACTER_LIMIT = 0.25
WORD_LIMIT = 0.24
DIGITS = 4  # shares are rounded for the medians, so an aggregation keeps at most 10,001 values of a bin

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CHARACTER_CLASSES = {"upper": "A-Z", "digits": "0-9", "symbols": SYMBOLS, "stops": ".,;:!?", "other": r"\x{80}-\x{10FFFF}"}

LANGUAGES = 10_000  # with a reference, up to which the references are sent to every task

# Frequent words of the languages; a language without a list gets that of its own documents.
COMMON_WORDS = {
    "en": "the of and to in a is that for was on are".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y a los del se las por".split(),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _repeats(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    size = F.size(hashes)

    def covered(ordered: Column) -> Column:
        same = lambda x, j: F.get(ordered, j)["h"] == x["h"]
        again = F.transform(ordered, lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"]))
        places = F.array_sort(F.filter(again, lambda p: p.isNotNull()))
        # A window adds the words up to the next repeated one, the last adds all.
        return let(places, lambda ps: F.aggregate(
            F.transform(ps, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x,
        ))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == size, 0).otherwise(let(F.array_sort(pairs), covered))


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words found twice or more, the first included; windows meet by 64-bit hashes."""
    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), _repeats)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)


def own_common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, list)``: the most frequent words of each language without a fixed list, in the documents that make its
    reference. As many as the fixed lists have, ``""`` where a language has fewer."""
    size = len(next(iter(COMMON_WORDS.values())))

    def judged(words: Column) -> Column:
        good = (F.size(words) >= DIVERGENCE_WORDS) & ~base_failed(F.size(words), repeated_words(words))
        return F.when(good, F.transform(words, F.lower)).otherwise(F.array().cast("array<string>"))

    rows = docs.filter(~F.col(lang).isin(list(COMMON_WORDS))).select(F.col(lang).alias("lang"), F.explode(let(words_of(F.col(text)), judged)).alias("word"))
    counts = rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= size)
    lists = ranked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word")))["word"].alias("list"))
    return lists.select("lang", F.concat("list", F.array_repeat(F.lit(""), F.lit(size) - F.size("list"))).alias("list"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= LANGUAGES else df


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts per row, from its whole text; a null text has none. ``common`` is null for rows without a language."""
    own = _few(cut_lineage(own_common_words(docs, text, lang)))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(lang).alias("lang")).join(own, "lang", "left")
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    lists = F.create_map(*[c for code, ws in COMMON_WORDS.items() for c in (F.lit(code), F.array(*map(F.lit, ws)))])

    def common(words: Column, lang: Column) -> Column:
        def counts(hits: Column, of: Column) -> Column:
            return let(hits, lambda hs: F.transform(of, lambda c: F.size(F.filter(hs, lambda h: h == c))))

        fixed = F.transform(F.filter(words, lambda w: F.lower(w).isin(every)), F.lower)
        own = F.filter(F.transform(words, F.lower), lambda w: F.array_contains(F.col("list"), w))
        return F.when(lang.isin(list(COMMON_WORDS)), counts(fixed, lists[lang])).when(F.col("list").isNotNull(), counts(own, F.col("list")))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"), F.length(F.concat_ws("", words)).cast("bigint").alias("word_chars"),
            repeated_words(words).cast("bigint").alias("n_repeat_words"), common(words, F.col("lang")).alias("common"),
        )

    counted = rows.select(
        "k", "lang", F.length("t").cast("bigint").alias("n_chars"), let(words_of(F.col("t")), of_words).alias("w"),
        repeated_lines(F.col("t")).cast("bigint").alias("n_dup_lines"),
        *[F.length(F.regexp_replace("t", f"[^{c}]+", "")).cast("bigint").alias(n) for n, c in CHARACTER_CLASSES.items()],
    )
    return counted.select(F.col("k").alias(key), "lang", "n_chars", "w.*", "n_dup_lines", *CHARACTER_CLASSES)


def _shares(counts: list[Column], total: Column) -> Column:
    """Shares of the total, the last one what the counts leave."""
    parts = [*counts, total - sum(counts[1:], counts[0])]
    return F.array(*[F.when(total > 0, c / total).otherwise(0.0) for c in parts])


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    def toward(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: toward(a, (a + b) / 2) + toward(b, (a + b) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _reference(df: DataFrame, column: str, size: int) -> list[Column]:
    return [F.percentile(F.round(F.col(column)[i], DIGITS), 0.5).alias(f"{column}{i}") for i in range(size)]


def _as_shares(column: str, size: int) -> Column:
    """The medians, made to sum to one."""
    parts = [F.col(f"{column}{i}") for i in range(size)]
    total = sum(parts[1:], parts[0])
    return F.when(total > 0, F.array(*[x / total for x in parts]))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and verdict per row: ``base_failed`` by length and repetition, ``kept`` also by divergence.

    Documents of at least ``DIVERGENCE_WORDS`` words that pass the base rules make their language's references and are
    held against them. A language without a fixed list of common words has that of these documents. Rows with a null
    language make no reference; they diverge if their characters are far from every language's, and are not judged by
    words. Where a language has no such document, there is no reference and nothing diverges.
    """
    characters, words = len(CHARACTER_CLASSES) + 2, len(next(iter(COMMON_WORDS.values()))) + 1
    spaces = F.col("n_chars") - F.col("word_chars")
    measured = cut_lineage(measure(docs, key, text, lang).select(
        F.col(key).alias("_k"), "lang", "n_words", "word_chars", F.col("symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        _shares([*[F.col(c) for c in CHARACTER_CLASSES], spaces], F.col("n_chars")).alias("c"),
        F.when(F.col("common").isNotNull(), _shares([F.col("common")[i] for i in range(words - 1)], F.col("n_words"))).alias("d"),
    ))
    judged = (F.col("n_words") >= DIVERGENCE_WORDS) & ~F.col("base_failed")
    medians = measured.filter(judged & F.col("lang").isNotNull()).groupBy("lang").agg(*_reference(measured, "c", characters), *_reference(measured, "d", words))
    # One row per language, and one with the characters of all of them for rows without.
    of_languages = cut_lineage(medians.select("lang", F.array(_as_shares("c", characters)).alias("c_refs"), _as_shares("d", words).alias("d_ref")))
    of_all = of_languages.agg(F.collect_list(F.col("c_refs")[0]).alias("c_refs")).select(
        F.lit(None).cast(of_languages.schema["lang"].dataType).alias("lang"), "c_refs", F.lit(None).cast("array<double>").alias("d_ref")
    )
    held = measured.alias("a").join(_few(of_languages.union(of_all)).alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left")
    far_characters = (F.size("c_refs") > 0) & F.forall("c_refs", lambda ref: _divergence(F.col("c"), ref) > CHARACTER_LIMIT)
    far = far_characters | (_divergence(F.col("d"), F.col("d_ref")) > WORD_LIMIT)
    return held.select(
        F.col("_k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(judged & far, F.lit(False))).alias("kept"),
    )
