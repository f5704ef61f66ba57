"""Queries of operators that other queries use inside: positions, order, limits, options, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as rl
from ..functions import secrets as sec
from ..operators import models, motifs
from ..sources import flags
from .catalog import ATTACKS, DOCS, FIRST, FOUND, HOT, MOTIF_ROWS, PLANTED, WINDOWS, documents, hot, pages, planted, q, query, sql_list

COMMANDS = [
    (["-h", "--raw", "x.org"], "true|true|||||x.org"),
    (["x.org", "-h", "--disable", "a", "--disable", "b", "--disable", "a"], "false|false|a,b||||x.org,-h"),
    (["--injection-threshold", "0.5", "--injection-threshold", "high", "--injection-action", "WARN", "--injection-action", "shout", "-L"], "false|false||0.5|warn||-L"),
    (["--injection-languages", "EN, fr,,de", "--render", "--enable"], "false|false||||en,fr,de|--enable"),
    (["--injection-languages"], "false|false|||||"),
    ([], "false|false|||||"),
]


@query("s7_flags", f"SELECT page_id, {sql_list([said for _, said in COMMANDS])}[(page_id % {len(COMMANDS)} + 1)::INT] AS flags FROM pages")
def s7(spark: SparkSession, d: str) -> DataFrame:
    args = F.get(F.array(*[F.array(*[F.lit(a) for a in own]).cast("array<string>") for own, _ in COMMANDS]), (F.col("page_id") % len(COMMANDS)).cast("int"))
    f = pages(spark, d).select("page_id", flags.extract_flags(args).alias("f"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    said = F.concat_ws("|", F.col("f.help").cast("string"), F.col("f.raw").cast("string"), listed("f.disable"), F.coalesce(F.col("f.threshold").cast("string"), F.lit("")), F.coalesce("f.action", F.lit("")), listed("f.languages"), listed("f.remaining"))
    return f.select("page_id", said.alias("flags"))


@query("x1_window_motifs", f"SELECT r.c AS category, r.m AS motif, count(*) AS windows FROM {WINDOWS}, {MOTIF_ROWS} WHERE contains(w, r.m) GROUP BY ALL")
def x1(spark: SparkSession, d: str) -> DataFrame:
    """How many windows hold each motif: places are found in whole texts, windows follow by arithmetic."""
    held = motifs.windows_with(motifs.find_exact(documents(spark, d), text="t"))
    return held.groupBy("category", "motif").agg(F.count(F.lit(1)).alias("windows"))


@query("x3_first_rule", f"SELECT doc_id, {FIRST} AS rule FROM {PLANTED} WHERE {FIRST} IS NOT NULL")
def x3(spark: SparkSession, d: str) -> DataFrame:
    """Rules as rows with their order; of those that match, the first."""
    order = F.filter(F.array(*[F.when(F.col("t").rlike(p), F.struct(F.lit(i).alias("at"), F.lit(n).alias("rule"))) for i, (n, p) in enumerate(sec.SECRETS)]), lambda x: x.isNotNull())
    return planted(spark, d).select("doc_id", F.explode(order).alias("r")).groupBy("doc_id").agg(F.min_by("r.rule", "r.at").alias("rule"))


@query("x5_template_samples", f"SELECT attack, count(*) AS n, sum(length(coalesce(text, '')) + 1 + length(attack))::BIGINT AS chars FROM (SELECT text, unnest([{sql_list(ATTACKS)}[(doc_id % 7 + 1)::INT], {sql_list(ATTACKS)}[((doc_id + 3) % 7 + 1)::INT]]) AS attack FROM documents) GROUP BY attack")
def x5(spark: SparkSession, d: str) -> DataFrame:
    """Two templates a document, chosen by its id: the selection comes before the pairs do."""
    listed = F.array(*[F.lit(a) for a in ATTACKS])
    some = F.array(*[F.get(listed, ((F.col("doc_id") + k) % 7).cast("int")) for k in (0, 3)])
    rows = spark.read.parquet(f"{d}/documents.parquet").select("text", F.explode(some).alias("attack"))
    return rows.groupBy("attack").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit(""))) + 1 + F.length("attack")).alias("chars"))


@query("w2_first_window", f"SELECT doc_id, motif, position, min(p)::INT AS window_start FROM (SELECT doc_id, r.m AS motif, (p + instr(w, r.m) - 1)::INT AS position, p FROM {WINDOWS}, {MOTIF_ROWS} WHERE contains(w, r.m)) GROUP BY ALL")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return motifs.find_exact(documents(spark, d), text="t").select("doc_id", "motif", "position", "window_start")


@query("w3_by_position", f"SELECT doc_id, string_agg(motif, ',' ORDER BY position, motif) AS motifs FROM {FOUND} GROUP BY doc_id")
def w3(spark: SparkSession, d: str) -> DataFrame:
    found = motifs.find_exact(documents(spark, d), text="t")
    placed = F.sort_array(F.collect_list(F.struct("position", "motif")))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(placed, lambda x: x["motif"]), ",").alias("motifs"))


@query("m2_located", f"SELECT doc_id, r.m AS motif, instr(low, r.m)::INT - 1 AS position FROM (SELECT doc_id, lower(t) AS low FROM {DOCS}), {MOTIF_ROWS} WHERE contains(low, r.m)")
def m2(spark: SparkSession, d: str) -> DataFrame:
    low = documents(spark, d).select("doc_id", F.lower("t").alias("low"))
    at = F.filter(F.array(*[F.struct(F.lit(m).alias("motif"), (F.locate(m, F.col("low")) - 1).alias("position")) for _, m in motifs.LISTED]), lambda x: x["position"] >= 0)
    return low.select("doc_id", F.explode(at).alias("m")).select("doc_id", "m.*")


@query("l1_sorted_hotspots", f"SELECT doc_id, string_agg(start || '-' || stop, ',' ORDER BY start) AS spots FROM {HOT} GROUP BY doc_id")
def l1(spark: SparkSession, d: str) -> DataFrame:
    placed = F.sort_array(F.collect_list(F.struct("start", "end")))
    spots = F.transform(placed, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return hot(spark, d).groupBy("doc_id").agg(F.array_join(spots, ",").alias("spots"))


@query("l2_top_motifs", f"SELECT motif, count(*) AS n FROM {FOUND} GROUP BY motif ORDER BY n DESC, motif LIMIT 5")
def l2(spark: SparkSession, d: str) -> DataFrame:
    return motifs.find_exact(documents(spark, d), text="t").groupBy("motif").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "motif").limit(5)




_WORD = "regexp_extract(coalesce(text, ''), '[a-z]+')"


@query("l8_valid_rules", f"SELECT DISTINCT {_WORD} || CASE WHEN doc_id % 4 = 2 THEN '+x' ELSE '' END AS expr FROM documents WHERE {_WORD} <> '' AND doc_id % 4 NOT IN (1, 3)")
def l8(spark: SparkSession, d: str) -> DataFrame:
    """Expressions made of the first words of documents, half of them broken; those that compile."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]+", 0)
    ends = F.get(F.array(F.lit(""), F.lit("("), F.lit("+x"), F.lit("[")), (F.col("doc_id") % 4).cast("int"))
    rows = spark.read.parquet(f"{d}/documents.parquet").filter(word != "").select(F.concat(word, ends).alias("expr")).distinct()
    return rl.valid_rows(rows)


@query("e1_embedding", f"SELECT doc_id, {models.DIMS} AS dims FROM documents")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.size(models.hash_embedding(F.col("t"))).alias("dims"))


@query("e3_mock_embedding", f"SELECT doc_id, CASE WHEN trim(t, {q(chr(32) + chr(9) + chr(10))}) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM {DOCS}")
def e3(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in gives unit vectors that depend on the text alone; texts without words give zeros."""
    v = documents(spark, d).select("doc_id", models.hash_embedding(F.col("t")).alias("v"))
    return v.select("doc_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))
