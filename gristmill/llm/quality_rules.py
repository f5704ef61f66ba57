"""Quality rules by distribution divergence, in DataFrame expressions only.

Every document gets surface counts (words, symbols, repeated lines, repeated five-word windows) and two
histograms: character classes, and the commonest function words of its language with a bin for all other words. Each
histogram is compared with the reference of the language, the sum over all its documents, by Jensen-Shannon distance (base 2, 0..1).

Defined results: a null text counts as empty; an empty text has no words and fails the base rule; a language
that is null or unlisted uses the pooled reference of all documents and no word histogram; a text of less than
``MIN_CHARS`` characters is not judged by its classes, one of less than ``MIN_JUDGED_WORDS`` words has word
distance 0; repeated rows are judged row by row; an empty table gives an empty result; columns of the input other than ``text`` and ``lang`` pass through, the operator's own columns carry
the prefix ``q_``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stored, table, text_or_empty, words

#: Function words of each listed language; parameters of the word histogram.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "as", "with", "be", "at", "this"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans", "sur", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
POOLED = "*"
#: Character classes, each by what is *not* in it; whatever is in none of them is the last class.
CLASSES = {
    "lower": "[^a-z]+",
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "stop": r"[^.,;:!?'\"()-]+",
    "symbol": "[^#*$%&|<>]+",
    "wide": r"[\x00-\x7F]+",
}
MAX_CLASS_DISTANCE = 0.33
#: Good texts of MIN_JUDGED_WORDS words are up to 0.24 from their language, texts without common words 0.3 and more.
MAX_WORD_DISTANCE = 0.27
MIN_CHARS, MIN_JUDGED_WORDS = 200, 100
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
_NO_LONGS = "cast(array() as array<bigint>)"


def _after(array: str, k: int) -> Column:
    """``array`` without its first ``k`` elements."""
    return F.slice(F.col(array), F.lit(k + 1), F.greatest(F.size(array), F.lit(1)))


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _repeated_words(df: DataFrame) -> DataFrame:
    """``q_repeat_words``: word positions inside five-word windows that the text holds twice or more.

    Windows are equal if their 64-bit hashes are; hashes are compared within one text only.
    """
    df = df.withColumn("q_h2", _pairs(F.col("q_words"), _after("q_words", 1)))
    df = df.withColumn("q_h4", _pairs(F.col("q_h2"), _after("q_h2", 2)))
    long_enough = F.col("q_n_words") >= WINDOW
    h5 = F.slice(_pairs(F.col("q_h4"), _after("q_words", 4)), F.lit(1), F.greatest(F.col("q_n_words") - (WINDOW - 1), F.lit(1)).cast("int"))
    df = df.withColumn("q_h5", F.when(long_enough, h5).otherwise(F.expr(_NO_LONGS))).drop("q_h2", "q_h4")
    repeats = F.size(F.array_distinct("q_h5")) < F.size("q_h5")
    placed = F.sort_array(F.transform("q_h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("q_at", F.when(repeats, placed)).drop("q_h5")
    twins = F.zip_with("q_at", _after("q_at", 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
    df = df.withColumn("q_starts", F.when(F.col("q_at").isNotNull(), starts)).drop("q_at")
    steps = F.zip_with("q_starts", _after("q_starts", 1), lambda p, q: F.coalesce(F.least(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("q_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("q_starts")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and histograms of each text."""
    df = docs.withColumn("q_text", text_or_empty())
    df = df.withColumn("q_words", words(F.col("q_text")))
    df = df.withColumn("q_n_words", F.size("q_words").cast("long"))
    df = _repeated_words(df)
    listed = F.col("lang").isin(list(COMMON_WORDS))
    df = df.withColumn("q_lang", F.when(listed, F.col("lang")).otherwise(F.lit(POOLED)))
    for name, other in CLASSES.items():
        df = df.withColumn(f"q_{name}", F.length(F.regexp_replace("q_text", other, "")).cast("long"))
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("q_lines", lines)
    df = df.withColumn("q_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")).drop("q_lines")
    df = df.withColumn("q_n_chars", F.length("q_text").cast("long"))
    df = df.withColumn("q_word_chars", F.col("q_n_chars") - F.col("q_space"))
    named = [F.col(f"q_{name}") for name in CLASSES]
    df = df.withColumn("q_classes", F.array(*named, F.col("q_n_chars") - reduce(lambda a, b: a + b, named)))
    # each word between two blanks of its own, so that counting a word is replacing a fixed string
    df = df.withColumn("q_spaced", F.concat(F.lit(" "), F.array_join("q_words", "  "), F.lit(" "))).drop("q_words", "q_text")
    shut = F.lit(0).cast("long")
    counts = F.lit(None).cast("array<bigint>")
    for lang, listed_words in COMMON_WORDS.items():
        each = [((F.length("q_spaced") - F.length(F.replace(F.col("q_spaced"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in listed_words]
        counts = F.when(F.col("q_lang") == lang, F.array(*each)).otherwise(counts)
    df = df.withColumn("q_common", F.coalesce(counts, F.array(*[shut] * len(COMMON_WORDS["en"]))))
    other = F.when(F.col("q_lang") != POOLED, F.aggregate("q_common", F.col("q_n_words"), lambda s, v: s - v)).otherwise(shut)
    return df.withColumn("q_common", F.concat("q_common", F.array(other))).drop("q_spaced", *[f"q_{n}" for n in CLASSES if n != "symbol"])


def references(measured: DataFrame) -> DataFrame:
    """One row per listed language and one for all documents together: the summed histograms.

    At most ``len(COMMON_WORDS) + 1`` rows, whatever the input.
    """
    n_classes, n_common = len(CLASSES) + 1, len(COMMON_WORDS["en"]) + 1
    sums = [F.sum(F.col("q_classes")[i]).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.col("q_common")[i]).alias(f"w{i}") for i in range(n_common)]
    rows = measured.rollup("q_lang").agg(F.grouping_id().alias("whole"), *sums)  # one pass for both
    rows = rows.filter((F.col("whole") == 1) | (F.col("q_lang") != POOLED)).withColumn("q_lang", F.coalesce("q_lang", F.lit(POOLED)))
    return rows.select("q_lang", F.array(*[f"c{i}" for i in range(n_classes)]).alias("q_ref_classes"), F.array(*[f"w{i}" for i in range(n_common)]).alias("q_ref_common"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length; 0 if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    sums = F.struct(total(a).alias("a"), total(b).alias("b"))

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(p) + part(q)) / 2

    divergence = F.aggregate(F.zip_with(a, b, lambda x, y: term(x / sums["a"], y / sums["b"])), F.lit(0.0), lambda s, v: s + v)
    return F.when((sums["a"] > 0) & (sums["b"] > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def verdict(measured: DataFrame, refs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_JUDGED_WORDS) -> DataFrame:
    """Adds ``q_class_distance``, ``q_word_distance``, ``q_base_failed`` and ``q_kept``."""
    df = measured.join(F.broadcast(refs), "q_lang", "left")
    n = F.col("q_n_words")
    df = df.withColumn("q_class_distance", js_distance(F.col("q_classes"), F.col("q_ref_classes")))
    df = df.withColumn("q_word_distance", F.when(n >= min_words, js_distance(F.col("q_common"), F.col("q_ref_common"))).otherwise(0.0))
    df = df.withColumn("q_base_failed", (n < MIN_WORDS) | (100 * F.col("q_repeat_words") > MAX_REPEAT_PERCENT * n))
    diverges = ((F.col("q_n_chars") >= min_chars) & (F.col("q_class_distance") > max_class)) | (F.col("q_word_distance") > max_word)
    return df.withColumn("q_kept", ~F.col("q_base_failed") & ~diverges).drop("q_ref_classes", "q_ref_common")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    packed = docs.select(F.struct(*docs.columns).alias("q_doc"), "text", "lang")  # apart from the operator's own names
    measured = stored(measure(packed).drop("text", "lang"), "measured")  # rows and counts together: measured once, no join back
    return verdict(measured, references(measured)).filter("q_kept").select("q_doc.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = stored(measure(docs).drop("text", "lang"), "quality")
    return verdict(measured, references(measured)).select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbol").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        F.round("q_class_distance", 6).alias("class_distance"),
        F.round("q_word_distance", 6).alias("word_distance"),
    )
