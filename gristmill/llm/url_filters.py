"""URL filters by a path-template tree, in DataFrame expressions only.

Rules judge first (the longest that fits). Urls judged by a rule are the labels of the tree. Per host, paths become templates
from the root on. At each node of the tree a segment stays literal where its branch has enough urls or labels and a share of the
node (``MIN_SHARE``, so at most 100 branches a node), else it becomes a wildcard. Literal branches of a node are merged where they are
statistically similar: each is compared with the branch of most labels among those whose next segments are mostly of
the same kind, by a chi-square test of the kinds of next segments (``CHILD_KINDS``) and, where both have labels, by a test of their block
rates. Merged branches are one branch from there on, named ``~`` and the branch compared with, so labels flow inside
merged branches only. A template is rejected if it holds ``MIN_LABELLED`` labels and their block rate, smoothed towards the
host's and this towards that of all labels, reaches ``MIN_PURITY``. Urls without a rule take the verdict of their template; a template
without labels of its own allows.

All of the tree is built from one row per (host, shape of the path), counted before anything is shuffled. Segments that all paths of
a node share are taken in one step, so the number of steps grows with the forks of a path, not with its length.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged like any other; a
segment of a url that reads like a wildcard or a merged branch (``*``, ``~x``) counts with it; paths of any depth are followed as long as a node has enough urls; repeated rows each get their row; an empty table gives an empty result; only
``page_id`` and ``url`` are read. The path may hold any characters, line ends included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
WILD = "*"
MIN_SUPPORT, MIN_SHARE = 20, 0.01
Z = 1.96
PRIOR_WEIGHT, MIN_LABELLED, MIN_PURITY = 10.0, 5, 0.9
MERGED = "~"
#: Kinds of a segment, the first that fits; a path that ends is the first kind.
CHILD_KINDS = {"end": None, "number": "^<n>$", "code": "^<x>$", "file": "[.]", "mixed": "<n>", "word": ""}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.coalesce(F.locate("://", F.col("url")), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("_rest", rest).withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn("path", path).drop("_rest")


def _fits(r: Rule) -> Column:
    host = F.col("host")
    return ((host == r.host) | host.endswith(f".{r.host}")) & F.col("path").startswith(r.path)


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits, else nulls."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    named = F.coalesce(*[F.when(_fits(r), F.lit(r.text)) for r in ranked]) if ranked else F.lit(None).cast("string")
    verdicts = F.coalesce(*[F.when(F.col("rule") == r.text, F.lit(r.verdict)) for r in ranked]) if ranked else F.lit(None).cast("string")
    return pages.withColumn("rule", named).withColumn("rule_verdict", verdicts)


def shape(path: Column) -> Column:
    """The path with runs of digits and long hexadecimal segments made variable."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("^(?=.*[0-9])[0-9a-f-]{12,}$"), F.lit("<x>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>")))


def _merged(branches: DataFrame) -> DataFrame:
    """(host, template, segment, name) of literal branches; similar branches of a node share their name."""
    bins = [f"k_{k}" for k in CHILD_KINDS]
    main = F.array_position(F.array(*bins), F.greatest(*bins))
    most = Window.partitionBy("host", "template", "main").orderBy(F.desc("labels"), F.desc("support"), "segment")
    df = branches.withColumn("main", main)
    df = df.select("*", *[F.first(c).over(most).alias(f"a_{c}") for c in ("segment", "support", "labels", "n_block", *bins)])
    up, down = F.sqrt(F.col("a_support") / F.col("support")), F.sqrt(F.col("support") / F.col("a_support"))
    chi, freedom = F.lit(0.0), F.lit(-1)
    for k in bins:
        both = F.col(k) + F.col(f"a_{k}")
        gap = up * F.col(k) - down * F.col(f"a_{k}")
        chi, freedom = chi + F.when(both > 0, gap * gap / both).otherwise(0.0), freedom + F.when(both > 0, 1).otherwise(0)
    alike = chi <= freedom + Z * F.sqrt(2.0 * freedom)
    pooled = (F.col("n_block") + F.col("a_n_block")) / (F.col("labels") + F.col("a_labels"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labels") + 1 / F.col("a_labels")))
    gap = F.abs(F.col("n_block") / F.col("labels") - F.col("a_n_block") / F.col("a_labels"))
    rates = F.when((F.col("labels") > 0) & (F.col("a_labels") > 0), gap <= Z * spread).otherwise(True)
    df = df.withColumn("into", F.when(alike & rates, F.col("a_segment")).otherwise(F.col("segment")))
    size = F.count(F.lit(1)).over(Window.partitionBy("host", "template", "into"))
    return df.select("host", "template", "segment", F.when(size > 1, F.concat(F.lit(MERGED), "into")).otherwise(F.col("segment")).alias("name"))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, shape, n, n_block, n_allow) with ``template``, the shape after generalisation and merging.

    A segment is added as long as a node has enough urls to keep a literal below it; where it has not, the rest is wildcards.
    """
    tree, done, step = shapes.select("*", F.lit("").alias("template"), F.lit(0).alias("at")), [], 0
    while True:
        left = F.size("shape") - F.col("at")
        deeper = tree.filter(left > 0).withColumn("rest", F.expr("slice(shape, at + 1, size(shape) - at)"))
        # what the least and the greatest list share, all between them share
        nodes = deeper.groupBy("host", "template").agg(F.sum("n").alias("total"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        same = F.expr("zip_with(slice(lo, 1, least(size(lo), size(hi))), slice(hi, 1, least(size(lo), size(hi))), (a, b) -> a = b)")
        shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
        nodes = nodes.select("host", "template", "total", shared.alias("shared"))
        placed = stored(tree.join(nodes, ["host", "template"], "left"), f"step{step}")
        ends = (left <= 0) | (F.col("total") < MIN_SUPPORT)
        done.append(placed.filter(ends).withColumn("template", F.concat("template", F.repeat(F.lit(f"/{WILD}"), F.greatest(left, F.lit(0))))).select(*shapes.columns, "template"))
        deep = placed.filter(~ends).withColumn("segment", F.when(F.col("shared") == 0, F.get("shape", F.col("at")))).withColumn("child", F.get("shape", F.col("at") + 1))
        if deep.isEmpty():
            break
        kind = F.when(F.col("child").isNull(), F.lit("end"))
        for k, pattern in CHILD_KINDS.items():
            kind = kind if pattern is None else kind.when(F.col("child").rlike(pattern), k)
        forks = deep.filter("shared = 0").withColumn("kind", kind)
        bins = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k_{k}") for k in CHILD_KINDS]
        branches = forks.groupBy("host", "template", "segment").agg(F.sum("n").alias("support"), F.sum("n_block").alias("n_block"), F.sum(F.col("n_block") + F.col("n_allow")).alias("labels"), F.first("total").alias("all"), *bins)
        kept = (F.col("support") >= MIN_SHARE * F.col("all")) & ((F.col("support") >= MIN_SUPPORT) | (F.col("labels") >= MIN_LABELLED))
        named = _merged(branches.filter(kept))
        added = F.when(F.col("shared") > 0, F.array_join(F.expr("slice(shape, at + 1, shared)"), "/")).otherwise(F.coalesce("name", F.lit(WILD)))
        tree = deep.join(named, ["host", "template", "segment"], "left").select(*shapes.columns, F.concat("template", F.lit("/"), added).alias("template"), (F.col("at") + F.greatest("shared", F.lit(1))).alias("at"))
        step += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def verdicts(tree: DataFrame) -> DataFrame:
    """(host, template, purity, rejected): the labelled block rate of each template, smoothed."""
    each = tree.groupBy("host", "template").agg(F.sum("n_block").alias("b"), F.sum(F.col("n_block") + F.col("n_allow")).alias("l"))
    each = stored(each, "templates")
    seen = each.agg(F.sum("b").alias("b"), F.sum("l").alias("l")).first()  # one row
    prior = (seen["b"] or 0) / seen["l"] if seen["l"] else 0.0
    smooth = lambda b, n, towards: (F.col(b) + PRIOR_WEIGHT * towards) / (F.col(n) + PRIOR_WEIGHT)
    hosts = each.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("l").alias("hl"))
    purity = smooth("b", "l", smooth("hb", "hl", F.lit(prior)))
    return each.join(hosts, "host").select("host", "template", purity.alias("purity"), ((F.col("l") >= MIN_LABELLED) & (purity >= MIN_PURITY)).alias("rejected"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row of ``pages`` (page_id, url)."""
    df = with_rule(with_parts(pages.select("page_id", "url")), rules).withColumn("shape", shape(F.col("path")))
    judged = lambda v: F.count(F.when(F.col("rule_verdict") == v, 1))
    shapes = df.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), judged("block").alias("n_block"), judged("allow").alias("n_allow"))
    tree = templates(stored(shapes, "shapes"))
    known = tree.select("host", "shape", "template").join(verdicts(tree), ["host", "template"])
    out = df.join(known, ["host", "shape"], "left")
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", "purity")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumn("purity", F.round("purity", 6))
