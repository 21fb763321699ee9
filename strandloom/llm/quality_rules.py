"""Quality rules: base counts, and the divergence of a document's make-up from its language's.

Per document one row of counts is derived in a single pass: words, symbols, repeated lines, words in
repeated windows, character classes and common words. The sum of these histograms over the documents
of a language that pass the base rules is that language's reference. A document is dropped if the
Jensen-Shannon distance of one of its histograms from the reference exceeds a limit; short documents,
whose histograms say little, aren't judged by it. Nor is a language with few documents or words its own
measure: its documents' character classes are compared with those of all languages together, and their common
words, which such a language has no reference for, not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small, text_of, words_of

#: Words of a window that counts as repeated.
WINDOW = 8
#: Base rules: fewest words, and the largest share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Documents of fewer words aren't judged by their histograms.
LEAST_JUDGED = 40
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of character classes and of common words. The
#: second lies below the distance of a text without common words, 0.27 to 0.29 in the four languages.
MOST_CLASSES, MOST_COMMON = 0.25, 0.24
#: Documents and words that a language's reference must come from.
LEAST_REFERENCE_DOCS, LEAST_REFERENCE_WORDS = 20, 2000
#: References are broadcast up to this number of languages.
MOST_BROADCAST = 10_000
# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "que",
    "der", "die", "und", "den", "von", "zu",
    "el", "y", "los", "se", "del", "por",
)
CLASSES = ("upper", "digit", "blank", "stop", "symbol", "wide", "other")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """A hash of each window of eight words, built up from pairs of ones, twos and fours."""

    def doubled(step: int) -> Callable[[Column], Column]:
        pick = lambda h, start: F.slice(h, start, F.size(h) - step)
        return lambda h: F.zip_with(pick(h, 1), pick(h, step + 1), lambda a, b: F.xxhash64(a, b))

    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        hashes = let(hashes, doubled(width))
        width *= 2
    return hashes


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more in the text, first occurrences included."""

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 2, F.size(places)), places, lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)  # the last has no gap and adds a whole window

    def of_sorted(s: Column) -> Column:
        as_next = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        twice = let(as_next, lambda n: F.zip_with(n, F.concat(F.array(F.lit(False)), n), lambda x, y: x | y))
        places = F.filter(F.zip_with(s, twice, lambda a, d: F.when(d, a["i"])), lambda x: x.isNotNull())
        return let(F.sort_array(places), covered)

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of_sorted))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(_windows(words), of)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return F.when(F.instr(text, "\n") == 0, F.lit(0)).otherwise(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long")


def profile(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common):
    the counts of each document and its two histograms."""
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(lang).alias("lang"), text_of(text).alias("text"))
    split = base.withColumn("words", words_of(F.col("text")))
    counted = split.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.char_length("text").cast("long").alias("chars"),
        F.when(F.octet_length("text") == F.char_length("text"), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x00-\x7F]"))).cast("long").alias("wide"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("upper"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("digit"),
        F.regexp_count("text", F.lit("[.,;:!?]")).cast("long").alias("stop"),
        F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(*COMMON_WORDS)), "  "), F.lit(" ")).alias("found"),
    )
    blank = F.col("chars") - F.col("word_chars")
    other = F.greatest(F.lit(0), F.col("chars") - blank - F.col("upper") - F.col("digit") - F.col("stop") - F.col("n_symbols") - F.col("wide"))
    classes = F.array(F.col("upper"), F.col("digit"), blank, F.col("stop"), F.col("n_symbols"), F.col("wide"), other)
    # found holds the common words, each between blanks of its own: a count is what its removal saves
    length = F.char_length("found")
    common = [((length - F.char_length(F.replace("found", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON_WORDS]
    rest = F.greatest(F.lit(0).cast("long"), F.col("n_words") - sum(common, F.lit(0).cast("long")))
    return counted.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", classes.alias("classes"), F.array(*common, rest).alias("common"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def references(profiles: DataFrame) -> DataFrame:
    """(of, n_docs, n_words, ref_classes, ref_common): summed histograms of each language's documents that pass
    the base rules; null is a language of its own."""
    bins = len(CLASSES), len(COMMON_WORDS) + 1
    sums = profiles.filter(~base_failed()).groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"), *[F.sum(F.col(name)[i]).alias(f"{name}{i}") for name, n in zip(("classes", "common"), bins, strict=True) for i in range(n)])
    return sums.select("of", "n_docs", "n_words", *[F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(f"ref_{name}") for name, n in zip(("classes", "common"), bins, strict=True)])


def pooled(refs: DataFrame) -> Column:
    """Class histogram of all languages together, if it comes from enough documents and words; else null."""
    sums = refs.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"), *[F.sum(F.col("ref_classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]).first()
    if (sums["n_docs"] or 0) < LEAST_REFERENCE_DOCS or sums["n_words"] < LEAST_REFERENCE_WORDS:
        return F.lit(None).cast("array<bigint>")
    return F.array(*[F.lit(sums[f"c{i}"]).cast("long") for i in range(len(CLASSES))])


def distance(one: Column, two: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; 0 if one of them is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(totals: Column) -> Column:
        terms = F.zip_with(one, two, lambda a, b: F.struct((a / totals["a"]).alias("p"), (b / totals["b"]).alias("q")))
        sum_ = F.aggregate(terms, F.lit(0.0), lambda s, x: s + part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2))
        return F.when((totals["a"] > 0) & (totals["b"] > 0), F.sqrt(F.greatest(F.lit(0.0), sum_ / 2))).otherwise(0.0)

    return let(F.struct(total(one).alias("a"), total(two).alias("b")), of)


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, common_distance) for each row of docs.

    Null texts are empty ones and fail the base rules, as all texts of too few words do. A document of
    a language that has no reference is judged by the classes of all languages; if the whole table is too small
    for a reference, by the base rules only. Repeated rows are judged alike.
    """
    profiles = settle(profile(docs, id_column, text, lang), "profiles")
    refs = settle(references(profiles), "references")
    everything = pooled(refs)
    known = refs.filter((F.col("n_docs") >= LEAST_REFERENCE_DOCS) & (F.col("n_words") >= LEAST_REFERENCE_WORDS)).drop("n_docs", "n_words")
    joined = profiles.join(small(known, MOST_BROADCAST), F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("ref_classes", F.coalesce("ref_classes", everything))
    measured = joined.withColumn("base_failed", base_failed()).withColumn("class_distance", F.coalesce(distance(F.col("classes"), F.col("ref_classes")), F.lit(0.0))).withColumn("common_distance", F.coalesce(distance(F.col("common"), F.col("ref_common")), F.lit(0.0)))
    strange = (F.col("n_words") >= LEAST_JUDGED) & ((F.col("class_distance") > MOST_CLASSES) | (F.col("common_distance") > MOST_COMMON))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~strange).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))
