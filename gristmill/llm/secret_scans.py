"""Secret scans over a ledger of blobs, in DataFrame expressions only.

Every version of a text is content-addressed (SHA-256); the ledger remembers which (blob, rule version) pairs
were scanned and what was found; only unseen pairs are scanned, each once however many documents carry the blob;
findings are joined back to all documents by address.

Defined results: a null text is the empty blob; a document without findings has counts 0 and empty strings;
repeated rows each get their row; the null doc_id is a document like any other; an empty table gives an empty
result; columns other than the key and the text are not read, so clashing names do no harm. Offsets are code points,
the end exclusive. Spans of one kind do not overlap, spans of different kinds may.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import scratch_dir, stored, table, text_or_empty, unused


@dataclass(frozen=True)
class Kind:
    """One kind of secret. A match counts if its ``group`` has ``least`` characters or more; others are passed over."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    #: Strings of which every match holds one; the pattern runs only on texts that do. None where nothing is fixed.
    gate: tuple[str, ...] = ()


#: The base kinds, in their fixed order. A run of the class is one match, so a minimum length of the whole
#: match may stand in the pattern itself: ``[0-9a-f]{24,}`` finds the runs of ``[0-9a-f]+`` with 24 or more.
BASE_KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", gate=("AKIA",)),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: A private key: from its header to the next END line; where that is missing, over the base64 body, which ends
#: with its last run of 16 or more characters and one shorter run after it; else the header alone.
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:[\x20\t\r\n]*(?:Proc-Type:\x20*4,ENCRYPTED|DEK-Info:\x20*[A-Za-z0-9,-]+)){0,2}"
    r"[A-Za-z0-9+/=\\\x20\t\r\n]*[A-Za-z0-9+/=]{16,}(?:[\\\x20\t\r\n]*[A-Za-z0-9+/=]+)?)?"
)
#: What the rules add to the base.
MORE_KINDS = (
    Kind("pem", _PEM, gate=("-----BEGIN ",)),
    Kind("forge", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", gate=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Kind("chat", r"xox[abeoprs]-[A-Za-z0-9-]{20,}", gate=("xox",)),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", gate=("eyJ",)),
    Kind("userinfo", r"://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", gate=("://",)),
    # the formats of functions/secrets.py that the kinds before do not hold; a longer token is taken whole
    Kind("forge_fine", r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59,}", gate=("github_pat_",)),
    Kind("npm", r"npm_[A-Za-z0-9]{36,}", gate=("npm_",)),
    Kind("pypi", r"pypi-[A-Za-z0-9_-]{50,}", gate=("pypi-",)),
    Kind("stripe", r"sk_(?:live|test)_[A-Za-z0-9]{24,}", gate=("sk_live_", "sk_test_")),
    Kind("google", r"AIza[0-9A-Za-z_-]{35,}", gate=("AIza",)),
    Kind("twilio", r"SK[0-9a-fA-F]{32,}", gate=("SK",)),
    Kind("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43,}", gate=("SG.",)),
    Kind("docean", r"dop_v1_[a-f0-9]{64,}", gate=("dop_v1_",)),
    Kind("doppler", r"dp\.pt\.[A-Za-z0-9]{43,}", gate=("dp.pt.",)),
    Kind("discord", r"[MN][A-Za-z0-9]{23,}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,}"),
    # a run of exactly 40: longer runs match as a whole, with an empty group
    Kind("aws_secret", r"[A-Za-z0-9/+=]{41,}|([A-Za-z0-9/+=]{40})", 1, 40),
)
KINDS = BASE_KINDS + MORE_KINDS
RULE_VERSION = "2"
SCANNED = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType())])
FOUND = T.StructType([*SCANNED.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("stop", T.LongType())])))])


def address(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _pieces(kind: Kind, number: int) -> Column:
    """Of one kind: (kind, gap before the match, length of the match, length of what is measured), in text order."""
    text = F.col("text")
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(group)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
    zipped = F.arrays_zip(gaps.alias("gap"), lengths(0).alias("size"), lengths(kind.group).alias("measured"))
    as_rows = F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["size"].alias("size"), z["measured"].alias("measured")))
    entry = F.struct(F.lit(number).alias("kind"), F.filter(as_rows, lambda z: z["size"].isNotNull()).alias("pieces"))
    found = text.rlike(kind.pattern)
    return F.when(reduce(lambda a, b: a | b, [text.contains(g) for g in kind.gate]) & found if kind.gate else found, entry)


def scan(blobs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(blob, spans) of every blob in ``blobs`` (blob, text) that has any; spans are sorted by start, then kind.

    Starts are sums over the gaps and matches before, within one kind of one text.
    """
    hits = blobs.select("blob", F.filter(F.array(*[_pieces(k, i) for i, k in enumerate(kinds)]), lambda k: k.isNotNull()).alias("kinds"))
    # the row's own number keeps rows of the same blob apart
    rows = hits.filter(F.size("kinds") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", "blob", F.explode("kinds").alias("k"))
    rows = rows.select("row", "blob", F.col("k.kind").alias("kind"), F.posexplode("k.pieces").alias("at", "m"))
    so_far = Window.partitionBy("row", "blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum((F.col("m.gap") + F.col("m.size")).cast("long")).over(so_far))
    least = F.element_at(F.array(*[F.lit(k.least) for k in kinds]), F.col("kind") + 1)
    rows = rows.filter(F.col("m.measured") >= least)
    span = F.struct((F.col("stop") - F.col("m.size")).alias("start"), "kind", "stop")
    return rows.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))


class Ledger:
    """What was scanned and found, as two tables in one folder; each increment appends."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_dir(spark, "ledger")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def scanned(self, rule_version: str) -> DataFrame:
        return self._read("scanned", SCANNED).filter(F.col("rule_version") == rule_version).select("blob")

    def found(self, rule_version: str) -> DataFrame:
        return self._read("found", FOUND).filter(F.col("rule_version") == rule_version).drop("rule_version").dropDuplicates(["blob"])

    def update(self, docs: DataFrame, key: str = "doc_id", kinds: tuple[Kind, ...] = KINDS, rule_version: str = RULE_VERSION) -> DataFrame:
        """Scan what is new in ``docs``; gives (key, blob) of every row of ``docs``.

        The findings are written before the record that they are complete, so an increment that dies is scanned again.
        """
        texts = docs.select(key, text_or_empty().alias("text")).withColumn("blob", address(F.col("text")))
        versions = stored(texts.select(key, "blob"), "versions")
        new = versions.groupBy("blob").agg(F.min(key).alias("first")).join(self.scanned(rule_version), "blob", "left_anti")
        new = stored(new, "unseen")
        to_scan = texts.join(new.withColumnRenamed("blob", "wanted"), F.col(key).eqNullSafe(F.col("first")) & (F.col("blob") == F.col("wanted")), "left_semi")
        scan(to_scan.select("blob", "text"), kinds).select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(f"{self.path}/found")
        new.select("blob", F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(f"{self.path}/scanned")
        return versions


def spans_of(docs: DataFrame, ledger: Ledger, key: str = "doc_id") -> DataFrame:
    """(key, blob, spans) of every row of ``docs``; spans is empty where nothing was found."""
    versions = ledger.update(docs, key)
    empty = F.array().cast(FOUND["spans"].dataType)
    return versions.join(ledger.found(RULE_VERSION), "blob", "left").select(key, "blob", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "\u2588", key: str = "doc_id") -> DataFrame:
    """``docs`` with every character of a span replaced by ``mark``; all columns stay, the text keeps its length.

    What is joined is the table of blobs with findings; while it is small Spark broadcasts it and no text is shuffled.
    """
    ledger = Ledger(docs.sparkSession)
    ledger.update(docs, key)
    blob, spans = (unused(docs, c) for c in ("found_blob", "found_spans"))
    found = stored(ledger.found(RULE_VERSION).select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "findings")
    kinds = "array<struct<start:bigint,stop:bigint>>"

    def step(out: Column, x: Column) -> Column:
        """Spans in order of start, each from where the ones before have ended."""
        at = F.coalesce(F.get(out, F.size(out) - 1)["stop"], F.lit(0))
        return F.when(x["stop"] <= at, out).otherwise(F.concat(out, F.array(F.struct(F.greatest(x["start"], at).alias("start"), x["stop"].alias("stop")))))

    cuts = F.aggregate(spans, F.array().cast(kinds), step)
    text = F.col("text")
    between = lambda low, high: F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))

    def whole(cuts: Column) -> Column:
        before = lambda i: F.coalesce(F.get(cuts, i - 1)["stop"], F.lit(0))
        pieces = F.transform(cuts, lambda x, i: F.concat(between(before(i), x["start"]), F.repeat(F.lit(mark), (x["stop"] - x["start"]).cast("int"))))
        return F.concat(F.array_join(pieces, ""), between(before(F.size(cuts)), F.length(text)))

    masked = F.aggregate(F.array(cuts), F.lit(""), lambda _, c: whole(c))  # binds the cuts once
    marked = docs.join(found, address(text_or_empty()) == F.col(blob), "left")
    return marked.withColumn("text", F.when(F.col(spans).isNotNull(), masked).otherwise(text)).select(*docs.columns)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(table(spark, sf_dir, "documents"), Ledger(spark))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "blob",
    )
