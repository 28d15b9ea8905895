"""Quality rules: base counts, then divergence from language references.

A document's characters fall into classes and its common words into one bin each (and one for all other words).  Both
histograms are compared with those of its language by the Jensen-Shannon distance (base 2, 0 to 1).  The references are
the summed histograms of all documents of a language; languages are those with a list of common words here, so the
references are a few rows.  Short documents are not judged: their histograms say little.

All work is in built-in functions, one pass over the text; no row leaves its partition but the references' partial sums.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, let, words, written

#: Common words by language (fixed values).
COMMON = {
    "en": "the of and to in a is that for it as was with be by on are this from not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Character classes by pattern, each taken from what the ones before it leave; the rest is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[ \t\n]+", r"[.,;:!?'\"()-]+", "[#*$%&|<>]+", r"[^\x00-\x7F]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Words from which on a document is compared, and the largest distances of a document that is kept.
JUDGED_WORDS = 80
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.32


def _repeat_words(w: Column) -> Column:
    """Words in windows of ``WINDOW`` words that are found twice or more in the text."""

    def repeats(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, j: (F.coalesce(F.get(s, j - 1).h == x.h, F.lit(False))) | (F.coalesce(F.get(s, j + 1).h == x.h, F.lit(False)))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x.i))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
        covered = F.aggregate(let(placed, starts), zero, lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW).cast("long"), i - a["last"])).alias("n"), i.alias("last")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered.n)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, repeats))


def _word_histogram(w: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all other words; null for other languages."""
    every = sorted({x for own in COMMON.values() for x in own})

    def counts(own: list[str]) -> Column:
        common = F.filter(F.transform(F.filter(w, lambda x: F.length(x) <= 6), lambda x: F.lower(x)), lambda x: x.isin(every))
        bins = lambda c: F.transform(F.array(*map(F.lit, own)), lambda x: F.size(F.filter(c, lambda y: y == x)).cast("long"))
        full = let(common, bins)
        return let(full, lambda b: F.array_append(b, F.size(w).cast("long") - F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)))

    return reduce(lambda found, own: found.when(lang == own[0], counts(own[1])), COMMON.items(), F.when(F.lit(False), F.array(F.lit(0).cast("long"))))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, the base counts and both histograms of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = df.select(F.col(id_col).alias("doc_id"), "lang", text.alias("text"), text.alias("rest"))
    sizes = []
    for i, pattern in enumerate(CLASSES):
        stripped = F.regexp_replace("rest", pattern, "")
        left = left.withColumn("next", stripped).withColumn(f"c{i}", (F.length("rest") - F.length("next")).cast("long")).withColumn("rest", F.col("next")).drop("next")
        sizes.append(F.col(f"c{i}"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), _word_histogram(w, F.col("lang")).alias("word_bins")
    )
    return left.select(
        "doc_id",
        "lang",
        let(words(F.col("text")), of_words).alias("w"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.array(*sizes, F.length("rest").cast("long")).alias("class_bins"),
    ).select("doc_id", "lang", "w.*", "word_chars", "n_symbols", "n_dup_lines", "class_bins")


def references(measured: DataFrame) -> dict[str, dict[str, list[int]]]:
    """Summed histograms by language: as many rows as there are lists of common words."""
    known = measured.where(F.col("lang").isin(list(COMMON)) & (F.col("n_words") >= JUDGED_WORDS))
    sums = [F.sum(F.col("class_bins")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    n_bins = len(next(iter(COMMON.values()))) + 1
    sums += [F.sum(F.col("word_bins")[i]).alias(f"w{i}") for i in range(n_bins)]
    found = known.groupBy("lang").agg(*sums).collect()
    return {r["lang"]: {"class_bins": [r[f"c{i}"] for i in range(len(CLASSES) + 1)], "word_bins": [r[f"w{i}"] for i in range(n_bins)]} for r in found}


def _distance(bins: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of a histogram to a reference histogram."""
    total = sum(reference)
    shares = F.array(*(F.lit(r / total) for r in reference))
    own_total = F.greatest(F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1).cast("long")).cast("double")
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    terms = F.zip_with(bins, shares, lambda b, q: let(F.struct((b / own_total).alias("p"), q.alias("q")), lambda s: (part(s.p, (s.p + s.q) / 2) + part(s.q, (s.p + s.q) / 2)) / 2))
    bits = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / math.log(2)
    return F.sqrt(F.greatest(bits, F.lit(0.0)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base counts, base_failed, class_distance, word_distance, kept.

    Null text has no words and fails the base rules.  A language that is null or has no reference gives no distance, and
    a text of fewer than ``JUDGED_WORDS`` words is not judged by distance; both stay if the base rules pass.  Repeated
    rows are judged alike.  Very long texts are read whole.  An empty table gives an empty result; other columns but the
    language are not read.
    """
    measured = written(measures(df, id_col, text_col))
    found = references(measured)

    def distance(bins: str) -> Column:
        none = F.when(F.lit(False), F.lit(0.0))
        return reduce(lambda so_far, lang: so_far.when(F.col("lang") == lang, _distance(F.col(bins), found[lang][bins])), found, none)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = (F.col("n_words") >= JUDGED_WORDS) & (
        F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    )
    judged = measured.withColumn("class_distance", distance("class_bins")).withColumn("word_distance", distance("word_bins"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance",
    )
