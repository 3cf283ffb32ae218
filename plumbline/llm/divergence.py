"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of common words are compared to those of its language, summed
over all documents of the language, by the Jensen-Shannon distance. How far a text may be off shrinks with its
length, since short texts are off by chance; texts under the guards' lengths aren't judged at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, WORD_BREAK, written

#: Common words of languages; other languages are measured by the first list.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "that", "was", "for", "on"),
    "de": ("der", "die", "und", "das", "nicht", "von", "zu", "mit", "ist", "den"),
    "fr": ("de", "la", "le", "les", "et", "des", "que", "une", "en", "un"),
    "es": ("de", "la", "que", "el", "en", "los", "del", "las", "por", "con"),
}
WORDS_LISTED = 10
CLASSES = ("lower", "upper", "digit", "space", "symbol", "point", "other")
#: Distances that a long text may have from its language's histograms, and the least lengths that are judged.
CHAR_DISTANCE, WORD_DISTANCE = 0.19, 0.19
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Windows of the repeat rule, in words. Fixed values of the base rules follow.
WINDOW = 8
BASE_WORDS, BASE_REPEAT = 20, 30


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to (.., words): the words in windows that are found twice or more in the text.

    Window hashes are made by doubling; only where some are equal are they sorted with their places.
    """
    df = docs.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))

    def doubled(was: str, step: int) -> Column:
        return F.transform(was, lambda h, i: F.xxhash64(h, F.get(was, i + step)))

    for step in (1, 2, 4):
        df = df.withColumn(f"h{2 * step}", doubled(f"h{step}", step)).drop(f"h{step}")
    n = F.size("words") - (WINDOW - 1)
    df = df.withColumn("h8", F.when(n > 1, F.slice("h8", 1, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("twice", F.size(F.array_distinct("h8")) < F.size("h8"))
    sorted_places = F.when(F.col("twice"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("order", sorted_places).drop("h8", "twice")
    same = lambda s, j: F.coalesce(F.get("order", j)["h"] == s["h"], F.lit(False))
    df = df.withColumn("places", F.array_sort(F.transform(F.filter("order", lambda s, j: same(s, j + 1) | same(s, j - 1)), lambda s: s["i"]))).drop("order")
    covered = F.transform("places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("places", j + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).drop("places")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, language, counts of the base rules, chars array<long>, words_hist array<long>) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), text.alias("t"))
    df = df.withColumn("bare", F.btrim("t", F.lit(SPACES)))
    df = df.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", WORD_BREAK))).drop("bare")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # What is neither a small letter nor a space is a small part of most texts; the other classes are counted there.
    df = df.withColumn("rest", F.regexp_replace("t", r"[a-z\x20\x09-\x0D]+", "")).withColumn("n_chars", F.length("t"))
    df = df.withColumn("joined", F.array_join("words", "  ")).withColumn("n_words", F.size("words").cast("long"))
    gaps = F.greatest(F.lit(0), F.col("n_words") - 1) * 2
    df = df.withColumn("word_chars", (F.length("joined") - gaps).cast("long"))
    only = lambda kept: F.length(F.regexp_replace("rest", f"[^{kept}]+", ""))
    df = df.withColumns({"upper": only("A-Z"), "digit": only("0-9"), "n_symbols": only(r"#*$%&|<>").cast("long"), "point": only(r""".,;:!?'"()\-"""), "space": F.col("n_chars") - F.col("word_chars")})
    df = df.withColumn("lower", F.col("n_chars") - F.col("space") - F.length("rest"))
    other = F.length("rest") - F.col("upper") - F.col("digit") - F.col("n_symbols") - F.col("point")
    chars = F.array(*[c.cast("long") for c in (F.col("lower"), F.col("upper"), F.col("digit"), F.col("space"), F.col("n_symbols"), F.col("point"), other)])
    # Listed words are short; of the few that pass, each is counted.
    short = lambda listed: F.filter("words", lambda w: (F.octet_length(w) <= max(map(len, listed))) & F.lower(w).isin(*listed))
    count = lambda w: F.size(F.filter("common", lambda x: x == w)).cast("long")
    counts = lambda listed: F.array(*map(count, listed))

    def by_language(of: Callable) -> Column:
        found = of(next(iter(COMMON.values())))
        for language, listed in COMMON.items():
            found = F.when(F.col("language") == language, of(listed)).otherwise(found)
        return found

    df = df.withColumn("common", F.transform(by_language(short), lambda w: F.lower(w))).withColumn("found", by_language(counts))
    df = df.withColumn("words_hist", F.concat("found", F.array(F.col("n_words") - F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x))))
    df = df.withColumn("chars", chars).select("doc_id", "language", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "chars", "words_hist")
    return _repeated_words(df).drop("words")


def _distance(own: Callable, of: Callable, width: int) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two histograms given as the counts of each class."""
    def share(counts):
        total = sum((counts(i) for i in range(width)), F.lit(0))
        return lambda i: F.when(total > 0, counts(i) / total).otherwise(F.lit(0.0))

    p, q = share(own), share(of)
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = [half(p(i), (p(i) + q(i)) / 2) + half(q(i), (p(i) + q(i)) / 2) for i in range(width)]
    return F.sqrt(F.greatest(F.lit(0.0), sum(parts, F.lit(0.0)) / 2))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed, kept and the two distances of every row.

    kept is false if base_failed, or if a histogram is further from its language's than its length explains. A
    null text has no words and fails the base rules. A null lang is a language of its own. Rows are judged one
    by one, so repeated rows give repeated rows; an empty table has no languages and no rows.
    """
    own = written(statistics(docs), "text-statistics")
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("words_hist")[i]).alias(f"w{i}") for i in range(WORDS_LISTED + 1)]
    languages = own.groupBy("language").agg(*sums)
    judged = own.join(languages, "language")
    chars = _distance(lambda i: F.col("chars")[i], lambda i: F.col(f"c{i}"), len(CLASSES))
    words = _distance(lambda i: F.col("words_hist")[i], lambda i: F.col(f"w{i}"), WORDS_LISTED + 1)
    judged = judged.withColumns({"char_distance": chars, "word_distance": words, "n_chars": F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)})
    # The distance that sampling alone gives: the root of (classes - 1) / (8 n ln 2), in about the mean.
    chance = lambda classes, n: F.sqrt(F.lit((classes - 1) / (8 * 0.6931471805599453)) / n)
    chars_far = (F.col("n_chars") >= LEAST_CHARS) & (F.col("char_distance") > CHAR_DISTANCE + chance(len(CLASSES), F.greatest(F.col("n_chars"), F.lit(1))))
    words_far = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > WORD_DISTANCE + chance(WORDS_LISTED + 1, F.greatest(F.col("n_words"), F.lit(1))))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~chars_far & ~words_far).alias("kept"), "char_distance", "word_distance",
    )
