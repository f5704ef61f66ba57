"""Coarse and fine scans, hotspots, batches and regions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import motif_hits, once, total_of
from ..functions.spans import SPANS
from .motifs import window_score

COARSE, COARSE_STEP, FINE, FINE_STEP = 4096, 2048, 512, 256
HOT, BATCH_SIZE, BATCH_GAP = 0.3, 1024, 256


def sizes(length: Column) -> dict[str, Column]:
    """Window sizes by the length of the text, for each row by itself."""
    short, long = length <= 1024, length > 16384
    big = F.least(F.lit(8192), F.floor(length / 4).cast("int"))
    return {
        "coarse": F.when(short, length).when(long, big).otherwise(COARSE),
        "coarse_step": F.when(short, length).when(long, F.floor(big / 2).cast("int")).otherwise(COARSE_STEP),
        "fine": F.when(short, F.least(F.lit(512), length)).otherwise(FINE),
        "fine_step": F.when(short, F.least(F.lit(256), F.floor(length / 2).cast("int"))).otherwise(FINE_STEP),
    }


def cut(df: DataFrame, low: Column, high: Column, size: Column, step: Column) -> DataFrame:
    """(…, start, end): windows over [low, high); texts up to 50 characters are one window, tails under 20 are left out."""
    n = high - low
    last = F.greatest(n - 1, F.lit(0))
    starts = F.when(n <= 0, F.array().cast("array<int>")).when(n <= 50, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.greatest(step, F.lit(1))))
    out = df.withColumn("at", F.explode(starts)).withColumn("start", low + F.col("at")).withColumn("end", F.when(n <= 50, high).otherwise(F.least(F.col("start") + size, high)))
    return out.filter((n <= 50) | (F.col("end") - F.col("start") >= 20)).drop("at")


def scored(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``density``, ``n_categories`` and ``score`` of each window, by motifs that occur whole in its sub-windows' text."""
    own = F.lower(F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))
    df = df.withColumn("hits", motif_hits(own))
    total = total_of(F.col("hits"))
    kinds = F.size(F.array_distinct(F.transform("hits", lambda h: h["category"])))
    df = df.withColumn("density", total * 1000.0 / F.greatest(F.col("end") - F.col("start"), F.lit(1))).withColumn("n_categories", kinds)
    top = F.when(F.col("n_categories") > 0, 100.0).otherwise(0.0)
    return df.withColumn("score", window_score(F.col("density"), F.col("n_categories"), top)).drop("hits")


def hotspots(windows: DataFrame, key: str = "doc_id", hot: float = HOT, step: int = COARSE_STEP) -> DataFrame:
    """(key, hotspot_id, start, end, peak_score, n_windows): hot windows no further than a coarse step apart."""
    order = Window.partitionBy(key).orderBy("start")
    rows = windows.filter(F.col("score") >= hot)
    new = F.coalesce(F.col("start") - F.lag("end").over(order) > step, F.lit(True))
    rows = rows.withColumn("hotspot_id", F.sum(F.when(new, 1).otherwise(0)).over(order))
    return rows.groupBy(key, "hotspot_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("peak_score"), F.count(F.lit(1)).alias("n_windows"))


def hotspots_of(text: Column) -> Column:
    """Sorted (start, end) of the ``hotspots`` of a text in its own row, from its coarse windows."""
    n = F.length(text)
    size = sizes(n)
    at = F.when(n > 50, F.sequence(F.lit(0), n - 1, F.greatest(size["coarse_step"], F.lit(1)))).otherwise(F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    each = F.transform(at, lambda s: F.struct(s.alias("start"), F.least(s + size["coarse"], n).alias("end")))
    wide = F.filter(each, lambda w: (n <= 50) | (w["end"] - w["start"] >= 20))

    def score(w: Column, hits: Column) -> Column:
        kinds = F.size(F.array_distinct(F.transform(hits, lambda h: h["category"])))
        density = total_of(hits) * 1000.0 / F.greatest(w["end"] - w["start"], F.lit(1))
        return window_score(density, kinds, F.when(kinds > 0, 100.0).otherwise(0.0))

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        near = (F.size(out) > 0) & (x["start"] - last["end"] <= COARSE_STEP)
        return F.when(near, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(x)))

    own = lambda w: motif_hits(F.lower(F.substring(text, w["start"] + 1, w["end"] - w["start"])))
    hot = F.filter(wide, lambda w: once(own(w), lambda hits: score(w, hits)) >= HOT)
    return F.aggregate(hot, F.array().cast(SPANS), step)


def drill(df: DataFrame, spots: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fine windows of each hotspot, padded by half a window and held within the text."""
    rows = spots.join(df.select(key, text), key)
    low, high = F.greatest(F.col("start") - FINE // 2, F.lit(0)), F.least(F.col("end") + FINE // 2, F.length(text))
    rows = rows.withColumn("low", low).withColumn("high", high).drop("start", "end")
    return cut(rows, F.col("low"), F.col("high"), F.lit(FINE), F.lit(FINE_STEP))


def batches(spots: Column, size: int = BATCH_SIZE, gap: int = BATCH_GAP) -> Column:
    """Sorted spots merged in order while the gap and the merged size stay within bounds."""

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        fits = (x["start"] - last["end"] <= gap) & (x["end"] - last["start"] <= size)
        return F.when((F.size(out) > 0) & fits, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))).otherwise(F.concat(out, F.array(x)))

    return F.when(F.size(spots) > 0, F.aggregate(F.slice(spots, 2, F.greatest(F.size(spots), F.lit(1))), F.slice(spots, 1, 1), step)).otherwise(spots)


def contained(outer: DataFrame, inner: DataFrame, key: str = "doc_id", cell: int = COARSE) -> DataFrame:
    """Pairs of ``outer`` and ``inner`` (key, start, end, ...) where the inner span lies within the outer one of the same key.

    A range join over cells of ``cell`` characters: an inner span meets in the cell of its start those outer spans that reach into
    it, so each pair meets once and spans of a long text far apart never do. Columns of ``inner`` get the prefix ``in_``.
    """
    inner = inner.select(F.col(key), *[F.col(c).alias(f"in_{c}") for c in inner.columns if c != key]).withColumn("_cell", F.floor(F.col("in_start") / cell))
    cells = F.sequence(F.floor(F.col("start") / cell), F.floor(F.greatest("start", F.col("end")) / cell))
    met = outer.withColumn("_cell", F.explode(cells)).join(inner, [key, "_cell"])
    return met.filter((F.col("in_start") >= F.col("start")) & (F.col("in_end") <= F.col("end"))).drop("_cell")


def regions(df: DataFrame, spots: DataFrame, merged: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """(key, start, end, peak, region): merged ranges (key, start, end) whose best contained hotspot reaches ``least``."""
    inside = contained(merged.select(key, "start", "end"), spots.select(key, "start", "end", "peak_score"), key)
    best = inside.groupBy(key, "start", "end").agg(F.max("in_peak_score").alias("peak"))
    return best.filter(F.col("peak") >= least).join(df.select(key, text), key).select(key, "start", "end", "peak", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("region"))


def around(spans: Column, length: Column, size: int = 512, gap: int = 256) -> Column:
    """Windows about the centres of ``spans``, merged if closer than ``gap``; the later end holds."""
    half = size // 2
    centre = F.transform(spans, lambda s: F.floor((s["start"] + s["end"]) / 2).cast("int"))
    each = F.transform(centre, lambda c: F.struct(F.greatest(c - half, F.lit(0)).alias("start"), F.least(c + half, length).alias("end")))

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        return F.when((F.size(out) > 0) & (x["start"] - last["end"] < gap), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))).otherwise(F.concat(out, F.array(x)))

    return F.when(F.size(each) > 0, F.aggregate(F.slice(each, 2, F.greatest(F.size(each), F.lit(1))), F.slice(each, 1, 1), step)).otherwise(each)


def word_chunks(df: DataFrame, text: str = "text", size: int = 200, overlap: int = 30) -> DataFrame:
    """(…, chunk_no, chunk): chunks of ``size`` words, each ``overlap`` words into the one before; a tail within the overlap is none."""
    df = df.withColumn("_words", F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    df = df.select("*", F.posexplode(starts).alias("chunk_no", "_at")).filter((F.col("_at") == 0) | (F.col("_at") + overlap < F.size("_words")))
    return df.withColumn("chunk", F.array_join(F.slice("_words", F.col("_at") + 1, F.lit(size)), " ")).drop("_words", "_at")


def chunks_of(text: str | None, size: int = 200, overlap: int = 30) -> list[str]:
    """``word_chunks`` of one text."""
    words = [w for w in re.split("[ \\t-\\r]+", text or "") if w]
    return [" ".join(words[at : at + size]) for at in range(0, len(words), size - overlap) if at == 0 or at + overlap < len(words)]


def rate_limited(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 10, seconds: int = 60) -> DataFrame:
    """Adds ``window_start``, ``allowed``, ``remaining`` and ``reset_at``: the first ``limit`` of a key in each aligned window pass."""
    start = F.floor(F.unix_timestamp(F.col(ts)) / seconds) * seconds
    order = Window.partitionBy(key, "window_start").orderBy(ts, "event_id")
    rows = events.withColumn("window_start", start).withColumn("n", F.row_number().over(order))
    allowed = F.col("n") <= limit
    return rows.withColumn("allowed", allowed).withColumn("remaining", F.when(allowed, limit - F.col("n")).otherwise(0)).withColumn("reset_at", F.col("window_start") + seconds).drop("n")
