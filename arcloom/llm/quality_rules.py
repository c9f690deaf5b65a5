"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character-class histogram and its histogram over the commonest words of its language are compared with
the language's own histograms by Jensen-Shannon distance. Both references are sums over all documents of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_col

#: Words in each language's common-word histogram.
COMMON_WORDS = 16
#: Documents with fewer words are not judged by divergence: their histograms are too thin.
MIN_WORDS = 50
#: Largest Jensen-Shannon distances (square root of the divergence in bits) that pass. A short document strays from
#: its language by chance, by about 1 / sqrt(words) in the word histogram, which WORD_NOISE allows for.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.25
WORD_NOISE = 1.0
#: Up to so many languages, the references (some hundred bytes each) are broadcast.
BROADCAST_LANGUAGES = 1_000
SYMBOLS = r"[#*$%&|<>]"
#: Character classes and the expressions that count them; white space and the rest follow from the length.
#: Letters are most of a text, so what is not a letter is counted.
CLASSES = {"n_upper": r"\p{Lu}", "n_other": r"\P{L}", "n_digit": r"\p{Nd}", "n_point": r"[.,;:!?'\"()-]"}


def windows_of(words: Column) -> Column:
    """A hash of each 3-word window of an array of words, in order."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(each, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, from the windows' hashes."""

    def of(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def again(s: Column) -> Column:
            same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])))
            places = F.sort_array(F.transform(same, lambda x: x["p"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        return F.get(F.transform(F.array(placed), again), F.lit(0))

    repeats = F.get(F.transform(F.array(hashes), of), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeats).cast("long")


def document_counts(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Every count of every document in one pass over its text; ``listed`` has the common words of each lang."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), text.alias("text"), words_col(text).alias("words"))
    # words and windows are columns of their own, so that what is not a lambda runs as generated code on them
    split = split.withColumn("windows", windows_of(F.col("words")))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    dup_lines = F.get(F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a))), F.lit(0))
    common = F.coalesce(F.col("ref_words"), F.expr("cast(array() as array<string>)"))
    return split.join(listed, "lang", "left").select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        *[F.regexp_count("text", F.lit(rule)).cast("long").alias(name) for name, rule in CLASSES.items()],
        word_histogram(F.col("words"), common).alias("word_counts"),
    )


def char_counts() -> Column:
    """Counts of the character classes in one order: upper, other letter, digit, point, symbol, space, rest."""
    space = F.col("n_chars") - F.col("word_chars")
    letters = F.col("n_chars") - F.col("n_other")
    rest = F.col("word_chars") - letters - F.col("n_digit") - F.col("n_point") - F.col("n_symbols")
    return F.array(F.col("n_upper"), letters - F.col("n_upper"), F.col("n_digit"), F.col("n_point"), F.col("n_symbols"), space, F.greatest(rest, F.lit(0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; 0 when either is empty of counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        sums = F.struct(total(a).alias("a"), total(b).alias("b"))

        def sized(s: Column) -> Column:
            def part(x, y):
                x, y = x / s["a"], y / s["b"]
                m = (x + y) / 2
                return term(x, m) / 2 + term(y, m) / 2

            return F.when((s["a"] <= 0) | (s["b"] <= 0), F.lit(0.0)).otherwise(F.sqrt(F.greatest(total(F.zip_with(a, b, part)), F.lit(0.0))))

        return F.get(F.transform(F.array(sums), sized), F.lit(0))

    pair = F.struct(p.cast("array<double>").alias("a"), q.cast("array<double>").alias("b"))
    return F.get(F.transform(F.array(pair), of), F.lit(0))


def common_word_lists(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """The commonest words of each language, counted over all its documents; ties go to the smaller word."""
    words = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.explode(words_col(F.lower("text"))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    listed = ranked.filter(F.col("rank") <= common_words).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("top"))
    return listed.select("lang", F.transform("top", lambda x: x["word"]).alias("ref_words"))


def language_references(counts: DataFrame) -> DataFrame:
    """One row for each language: its summed character-class counts and its summed common-word counts."""
    names = ("n_chars", "word_chars", "n_symbols", *CLASSES)
    chars = counts.groupBy("lang").agg(*[F.sum(c).alias(c) for c in names]).select("lang", char_counts().alias("ref_chars"))
    each = counts.select("lang", F.posexplode("word_counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    words = each.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("ref_counts"))
    return chars.join(words, "lang")


def by_language(table: DataFrame, name: str) -> DataFrame:
    """A table with one row for each language: broadcast while it is small, which is checked, and joined plainly else."""
    table = stored(table, name)
    return F.broadcast(table) if table.count() <= BROADCAST_LANGUAGES else table


def word_histogram(words: Column, listed: Column) -> Column:
    """How often each listed word occurs, and last how many other words there are."""
    longest = F.coalesce(F.array_max(F.transform(listed, F.length)), F.lit(0))

    def of(x: Column) -> Column:
        # lower case has no fewer characters, so longer words are not looked for
        known = F.filter(x["words"], lambda w: (F.length(w) <= x["longest"]) & F.array_contains(x["listed"], F.lower(w)))

        def counted(k: Column) -> Column:
            each = F.transform(x["listed"], lambda name: (F.size(k) - F.size(F.array_remove(k, name))).cast("long"))
            return F.concat(each, F.array((F.size(x["words"]) - F.size(k)).cast("long")))

        return F.get(F.transform(F.array(F.transform(known, F.lower)), counted), F.lit(0))

    return F.get(F.transform(F.array(F.struct(words.alias("words"), listed.alias("listed"), longest.alias("longest"))), of), F.lit(0))


def quality_references(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row for each language of ``docs`` (which should be clean): its commonest words and its two histograms."""
    lists = stored(common_word_lists(docs, common_words), "lists")
    return lists.join(language_references(document_counts(docs, by_language(lists, "lists"))), "lang")


def quality_rules(
    docs: DataFrame,
    common_words: int = COMMON_WORDS,
    min_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    word_noise: float = WORD_NOISE,
    references: DataFrame | None = None,
) -> DataFrame:
    """Counts, both distances and the verdict of every document.

    ``references`` (lang, ref_words, ref_chars, ref_counts, as quality_references() gives them) are the histograms to
    compare with; without them each language's own sums over all of ``docs`` serve, so that what most of a language's
    documents have in common passes. Documents of a language that given references lack have distances 0.
    ``docs`` needs doc_id, text and lang; other columns are ignored. Null text is no words, null lang is a language of
    its own. One row for each input row, repeated rows included. A document with fewer than ``min_words`` words has
    distances null and fails the base rules; an empty table gives an empty result.
    """
    lists = common_word_lists(docs, common_words) if references is None else references.select("lang", "ref_words")
    counts = stored(document_counts(docs, by_language(lists, "lists")), "counts")
    known = language_references(counts) if references is None else references.select("lang", "ref_chars", "ref_counts")
    base = counts.join(by_language(known, "references"), "lang", "left")
    enough = F.col("n_words") >= min_words
    judged = base.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.when(enough, F.round(F.coalesce(js_distance(char_counts(), F.col("ref_chars")), F.lit(0.0)), 9)).alias("char_distance"),
        F.when(enough, F.round(F.coalesce(js_distance(F.col("word_counts"), F.col("ref_counts")), F.lit(0.0)), 9)).alias("word_distance"),
    )
    passes = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance + word_noise / F.sqrt(F.greatest("n_words", F.lit(1)))
    )
    return judged.withColumn("kept", ~F.col("base_failed") & passes)
