"""Spelling variants of words, grouped by a symmetric-delete join.

Every word of the corpus emits itself and its distinct single deletions as keys. Two words that differ by one inserted,
deleted or replaced code point share exactly one key: the shorter word, or both without the replaced letter. So an equi-join
on keys meets each near pair once, and what it meets is verified to be at distance one. The words of one key are those
that have one letter more than it, so their number is bounded by the alphabet and the key's length, whatever
the corpus. A word's form is its near word of largest count, if that is ten times its own; roots are found by joining forms
with forms, doubling the steps each round.

Keys are 64-bit polynomial hashes of the strings, all deletions of a word in time linear in its length, so that very long words
cost no more than others; an equal hash alone links nothing, as pairs are verified on the words. Words longer than ``LONG``
travel as their digest and are joined back for that.

Defined results: null and empty texts have no words; a null id counts as an empty one in the hash that picks runs; repeated rows
are counted each; ties of the largest count go to the smallest word in code-point order; a word without form is its own
root; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import stored, table

LEAST_LENGTH, LEAST_COUNT = 7, 2
TIMES = 10
#: Code points from which on a word travels as its digest.
LONG = 64
#: Keys made at a time, or those of one longer word.
KEYS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _picked(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(least: int, altered: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), r"[^a-z\x{C0}-\x{FF}]+")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            some = pc.greater_equal(pc.utf8_length(flat), least)
            words = flat.filter(some)
            if altered and len(words):
                starts = [zlib.crc32(b"%s:" % (b"" if k is None else str(k).encode())) for k in batch.column("id").to_pylist()]
                start = np.repeat(np.array(starts, np.int64), sizes)[some.to_numpy(zero_copy_only=False)]
                h = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist(), start.tolist()), np.int64, len(words))
                hit = h % 31 == 0
                changed = [_picked(w, x) for w, x in zip(words.filter(pa.array(hit)).to_pylist(), h[hit].tolist(), strict=True)]
                words = pa.concat_arrays([words.filter(pa.array(~hit)), pa.array([w for w in changed if len(w) >= least], pa.string())])
            counts = pc.value_counts(words)
            yield pa.record_batch([counts.field("values"), counts.field("counts")], ["word", "n"])

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, altered: bool = False) -> DataFrame:
    """(word, n) of all words of ``least`` code points or more that occur twice; ``altered`` deletes a letter of the runs that a hash picks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counted(least, altered), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, ...]:
    """(word number, key, first, last): each word's own key (first and last are -1), and of each distinct deletion the
    places of the letters whose loss gives it."""
    text = "".join(words.to_pylist())
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(c)) - begin[word]
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _BASE))
    value = (c ^ (c >> np.uint64(3))) * np.uint64(0xD6E8FEB86659FD93) * power[at]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    head, whole = upto[:-1] - upto[begin[word]], upto[begin[1:]] - upto[begin[:-1]]
    without = head + (whole[word] - head - value) * _INVERSE
    first = np.flatnonzero((at == 0) | (c != np.concatenate([c[:1], c[:-1]])))  # the first of equal letters
    last = np.concatenate([first[1:] - 1, [len(c) - 1]]) if len(first) else first
    none = np.full(len(size), -1)
    return np.concatenate([np.arange(len(size)), word[first]]), np.concatenate([whole, without[first]]).view(np.int64), np.concatenate([none, at[first]]), np.concatenate([none, at[last]])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.utf8_length(batch.column("word")).to_numpy().astype(np.int64) + 1)
        cuts = np.flatnonzero(np.diff(size // KEYS)) + 1 if len(size) else []
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if a == b:
                continue
            own = batch.slice(a, b - a)
            number, key, first, last = deletion_keys(own.column("word"))
            number = pa.array(number, pa.int64())
            yield pa.record_batch([pa.array(key), pa.array(first, pa.int32()), pa.array(last, pa.int32()), own.column("name").take(number), own.column("n").take(number)], ["key", "first", "last", "name", "n"])


def _is_long(name: Column) -> Column:
    return F.startswith(name, F.lit("#"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every word with each word at distance one, from (word, n) of distinct words."""
    named = words.select(F.when(F.char_length("word") > LONG, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word")).alias("name"), "word", "n")
    with small_batches(words.sparkSession, 10_000):
        keys = stored(named.mapInArrow(_keys, "key long, first int, last int, name string, n long"), "keys")
    a, b = (keys.select("key", *(F.col(c).alias(f"{side}_{c}") for c in keys.columns if c != "key")) for side in "ab")
    # a word and a longer one, or two that lose letters in the same place
    fits = (F.col("a_first") == -1) | (F.col("b_first") == -1) | ((F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last")))
    either = _is_long(F.col("a_name")) | _is_long(F.col("b_name"))
    one = F.levenshtein("a_name", "b_name", 1) == 1
    met = a.join(b, "key").filter((F.col("a_name") != F.col("b_name")) & fits & (either | one)).select("a_name", "b_name", "b_n")
    met = stored(met, "met")
    short = met.filter(~either).toDF("word", "near", "near_n")
    full = stored(named.filter(F.char_length("word") >= LONG).select("name", "word"), "long")
    own, other = full.toDF("a_name", "word"), full.toDF("b_name", "near")
    long = met.filter(either).join(own, "a_name").join(other, "b_name").filter(F.levenshtein("word", "near", 1) == 1)
    return short.unionByName(long.select("word", "near", F.col("b_n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) ends. Counts grow along it, so it has no ring and few steps."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form = -F.col("best.less") >= times * F.col("n")
    each = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.less")).cast("long").alias("form_n")), "forms")
    ends = roots(each.filter("form is not null"))
    return each.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        words = stored(word_counts(table(spark, sf_dir, "documents"), altered=True), "counted")
    return variants(words)
