"""The whole model in one staged plan: pattern, motif and text vectors of suspicious texts, judged by a saved forest.

Texts without any pattern or motif are done after detection: they keep their pattern score and never reach windows or
vectors. Of the others those parts go on that show most: windows about the matches of long texts, else the batched hotspots
of very long ones, else the start. Vectors of the parts are pooled; 12 pattern features, 9 motif features and the pooled
vector make the row that the forest judges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as feats
from ..functions import spans as sp
from ..functions.rules import CATEGORIES, MOTIFS
from . import actions, models, motifs, windows

#: Lengths from which on parts stand for a text, and what is read of a text without parts.
PARTS_FROM, HOTSPOTS_FROM, START = 1024, 4096, 2048
LEAST_PART = 20
NAMES = [*CATEGORIES, "text_length", "special_char_ratio", "caps_ratio", "newline_density", "avg_word_length", "motif_density", *[f"motif_{c}" for c in MOTIFS], "motif_top", "motif_categories"]


def _spans(text: Column) -> Column:
    return F.when(F.length(text) > PARTS_FROM, sp.norm_spans(text))


def _parts(text: Column, spans: Column) -> Column:
    """Array of (start, end) of the parts of a normalised text, in its own row; ``spans`` are its ``_spans``."""
    n = F.length(text)
    about = F.filter(windows.around(spans, n), lambda w: w["end"] - w["start"] > LEAST_PART)
    start = F.array(F.struct(F.lit(0).alias("start"), F.least(n, F.lit(START)).alias("end")))
    spots = F.when(n > HOTSPOTS_FROM, windows.hotspots_of(text)).otherwise(F.array().cast(sp.SPANS))
    rest = feats.once(spots, lambda s: F.when(F.size(s) > 0, windows.batches(s)).otherwise(start))
    return F.when(F.size(spans) > 0, about).otherwise(rest)


def parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end) of the parts of each text that are made vectors of; ``text`` is normalised."""
    rows = df.select(key, text, F.inline(F.array(F.struct(_spans(F.col(text)).alias("_spans")))))
    return rows.select(key, F.inline(_parts(F.col(text), F.col("_spans"))))


def _with_features(detected: DataFrame, text: Column) -> DataFrame:
    """Adds ``_features``, null where ``text`` is: all that makes them is found in the text's own row, the text is not read again."""
    # generated rows: what follows names them more than once, and they are found once
    found = F.struct(text.alias("_text"), motifs.exact_hits(text).alias("_found"), _spans(text).alias("_spans"))
    rows = detected.select("*", F.inline(F.array(found)))
    text = F.col("_text")
    rows = rows.select("*", F.inline(F.array(F.struct(F.when(text.isNotNull(), _parts(text, F.col("_spans"))).alias("_parts")))))
    rows = rows.withColumn("_vector", models.part_embedding(text, F.col("_parts")))
    signal = motifs.signal_of(F.col("_found"), F.length(text))[2:]
    own = F.array(*[F.col(c) for c in CATEGORIES], *feats.statistics(text).values(), *signal)
    return rows.withColumn("_features", F.when(text.isNotNull(), F.concat(own, "_vector"))).drop("_text", "_found", "_spans", "_parts", "_vector")


def features(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, features): ``NAMES`` and the vector of every row of ``detect``, whose texts are ``norm_text``. No row meets another."""
    rows = _with_features(detected.select(key, "norm_text", *CATEGORIES), F.col("norm_text"))
    return rows.select(key, F.col("_features").alias("features"))


def assessed(df: DataFrame, model, key: str = "doc_id", text: str = "text", threshold: float | Column = feats.THRESHOLD) -> DataFrame:  # noqa: ANN001
    """``detect`` with ``score``, ``flagged`` and ``mode`` of the whole model for suspicious rows; ``key`` is unique.

    Other rows keep the pattern score and the mode ``pattern-only``: they have neither parts nor vectors, and what the forest says of
    their zeros is not read. Every row is detected once and meets no other.
    """
    found = actions.detect(df, text, threshold)
    rows = _with_features(found, F.when(F.col("suspicious"), F.col("norm_text")))
    none = F.array_repeat(F.lit(0.0), len(NAMES) + models.DIMS)
    rows = rows.select(F.struct(*found.columns).alias("_row"), F.coalesce("_features", none).alias("features"))
    rows = models.infer(model, rows).select("_row.*", "p")
    full = F.col("suspicious")
    # the verdict comes before the score of the patterns is replaced
    rows = rows.withColumn("flagged", F.when(full, F.col("p") >= threshold).otherwise(F.col("flagged"))).withColumn("score", F.when(full, F.col("p")).otherwise(F.col("score")))
    return rows.withColumn("mode", F.when(full, F.lit("full")).otherwise("pattern-only")).drop("p")
