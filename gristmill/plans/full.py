"""Queries of staged plans: the JSON interface on rows, the features of suspicious texts, the whole model, misspelt attacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import CATEGORIES
from ..operators import actions, full_model, models
from ..sources import api
from .catalog import _ANY, DOCS, SCORED, detected, documents, q, query

_TEXT = "CASE WHEN doc_id % 9 = 5 THEN repeat(t, 300) ELSE t END"
_KIND = "doc_id % 9"
#: Bodies by turns: a text, HTML, broken JSON, no text, a bad threshold, a very long text, an action and a threshold of their own.
_STATUS = f"CASE WHEN {_KIND} = 2 THEN 400 WHEN {_KIND} = 4 THEN 500 WHEN {_KIND} = 3 OR t = '' THEN 400 WHEN strlen({_TEXT}) > 262144 THEN 413 ELSE 200 END"
_ERROR = f"CASE WHEN {_KIND} = 2 THEN 'Invalid JSON' WHEN {_KIND} = 4 THEN 'could not convert string to float: ''high''' WHEN {_KIND} = 3 OR t = '' THEN {q("Missing 'html' or 'text' field")} WHEN strlen({_TEXT}) > 262144 THEN 'Input too large (' || strlen({_TEXT}) // 1024 || ' KB). Maximum is 256 KB.' END"


@query("s11_convert", f"SELECT doc_id, {_STATUS} AS status, {_ERROR} AS error, {_STATUS} = 200 AS has_reply FROM {DOCS}")
def s11_convert(spark: SparkSession, d: str) -> DataFrame:
    """Documents as request bodies, good and bad ones."""
    kind = F.col("doc_id") % 9
    text = F.when(kind == 5, F.repeat("t", 300)).otherwise(F.col("t"))
    own = lambda *fields: F.to_json(F.struct(*fields))
    body = (
        F.when(kind == 1, own(F.concat(F.lit("<p>"), text).alias("html"))).when(kind == 2, F.concat(F.lit('{"text": '), "t")).when(kind == 3, own(F.lit(0.5).alias("threshold")))
        .when(kind == 4, own(text.alias("text"), F.lit("high").alias("threshold"))).when(kind == 6, own(text.alias("text"), F.lit("datamark").alias("action"))).when(kind == 7, own(text.alias("text"), F.lit(0.9).alias("threshold"), F.lit("metadata").alias("action")))
        .otherwise(own(text.alias("text")))
    )
    body = F.when((kind == 1) & (F.col("t") == ""), own(F.lit("").alias("html"))).otherwise(body)
    out = api.convert(documents(spark, d).select("doc_id", body.alias("body")))
    return out.select("doc_id", "status", "error", F.get_json_object("reply", "$.markdown").isNotNull().alias("has_reply"))


@query("e4_feature_concat", f"SELECT doc_id, 405 AS width, round({' + '.join(f'd_{c}' for c in CATEGORIES)}, 6) AS patterns FROM {SCORED} WHERE {_ANY}")
def e4(spark: SparkSession, d: str) -> DataFrame:
    """Pattern features, motif features and the pooled vector of suspicious documents in one row."""
    rows = full_model.features(detected(spark, d).filter("suspicious"))
    seven = F.aggregate(F.slice("features", 1, len(CATEGORIES)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", F.size("features").alias("width"), F.round(seven, 6).alias("patterns"))


@query("e9_full_model")
def e9(spark: SparkSession, d: str) -> DataFrame:
    """A forest on the features of suspicious documents of even ids, with labels by their planted attacks, judges all documents."""
    suspicious = detected(spark, d).filter("suspicious and doc_id % 2 = 0")
    rows = full_model.features(suspicious).withColumn("label", (F.col("doc_id") % 3 == 0).cast("int"))
    model = models.train(rows, trees=20, depth=8)
    return full_model.assessed(documents(spark, d), model, text="t").select("doc_id", "mode", "score", "flagged")


@query("d2_misspelt")
def d2(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents behind a misspelt attack: motifs count and are masked where they are misspelt."""
    rows = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ignroe previuos, yuo are now; "), "t")).otherwise(F.col("t")).alias("text"))
    found = actions.acted(actions.detect(rows, threshold=0.05, fuzzy="doc_id"), threshold=0.05, fuzzy="doc_id")
    return found.select("doc_id", F.round("motif_density", 6).alias("motif_density"), "flagged", F.sha2(F.col("output").cast("binary"), 256).alias("digest"))
