"""Pages as rows of tokens: nodes with their text and link density, the main content, and markdown.

A page is split into tags and texts. Its tree shows in running sums over the tokens of a page: an opening tag of a
container lifts the depth, a closing one lowers it; the next container tag at a node's depth is its end; what lies
between are differences of running sums. Markdown is laid out the same way: breaks number the lines, running states
(list, quote, heading, table, preformatted) say how a line looks.

Every distinct page is laid out once: the windows and sums of a page all follow the one exchange by its digest. A page's tokens
are sorted in one task, as any work on a whole page needs. Malformed pages are read leniently: a container that is never closed
ends with its parent's next sibling or the page, a tag without a container has no depth, a lone ``<`` is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as ht
from ..functions.text import SPACE

# Elements whose content is no text of the page.
SILENT = ["script", "style", "noscript", "template", "head"]
CONTAINERS = ["body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "ul", "ol", "blockquote", "pre", "figure", "td"]
#: Containers that hold what goes with a page, not what it says.
AROUND = ["nav", "aside", "footer", "form"]
MAIN = ["article", "main"]
BLOCKS = ["p", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "blockquote", "pre", "figure", "figcaption", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "dl", "address", "fieldset"]
LINES = ["li", "tr", "dt", "dd", "caption", "option"]
WRAPPED = {"b": "**", "strong": "**", "i": "_", "em": "_"}
TOKEN = "</?[a-zA-Z][^>]*>|[^<]+|<"
NAME = "^</?([a-zA-Z][a-zA-Z0-9]*)"
_END = 2147483647


def attribute_pattern(name: str) -> str:
    return f"(?is)\\s{name}\\s*=\\s*[\"']?([^\"'>\\s]*)"


def alt_pattern() -> str:
    return "(?is)\\salt\\s*=\\s*\"([^\"]*)\""


def without_silent(c: Column) -> Column:
    c = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    for tag in SILENT:
        c = F.regexp_replace(c, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>", "")
    return F.regexp_replace(c, "<![^>]*>", "")


def _so_far(*by: str) -> Window:
    return Window.partitionBy("page", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _when(condition: Column, value: object = 1) -> Column:
    return F.when(condition, value)


def _level(names: list[str]) -> Column:
    """How many elements of ``names`` are open."""
    own = F.col("name").isin(names)
    return F.sum(F.when(own & F.col("opens"), 1).when(own & F.col("closes"), -1).otherwise(0)).over(_so_far())


def tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page, pos, tok, name, opens, closes, body, text) of every distinct page: its digest, place, token, tag name (empty for texts),
    decoded text and characters of it that are no white space."""
    rows = pages.filter(F.col(html).isNotNull()).select(F.sha2(F.col(html).cast("binary"), 256).alias("page"), F.col(html).alias("html")).dropDuplicates(["page"])
    rows = rows.select("page", F.posexplode(F.regexp_extract_all(without_silent(F.col("html")), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    name = F.lower(F.regexp_extract("tok", NAME, 1))
    rows = rows.withColumn("name", name)
    is_text = F.col("name") == ""
    rows = ht.decoded(rows.withColumn("body", F.when(is_text, F.col("tok"))), "body")
    closes = F.col("tok").startswith("</") & ~is_text
    opens = ~closes & ~is_text & ~F.col("tok").endswith("/>")
    return rows.withColumns({"opens": opens, "closes": closes, "text": F.when(is_text, F.length(F.regexp_replace("body", f"[{SPACE}]", ""))).otherwise(0)})


def measured(tok: DataFrame) -> DataFrame:
    """Adds ``depth``, ``thin`` (whether a text is a link's or stands in what goes around the content) and the running sums of texts."""
    link = F.coalesce(F.last(F.when(F.col("name") == "a", F.col("opens")), True).over(_so_far()), F.lit(False))
    tok = tok.withColumns({"depth": _level(CONTAINERS), "around": _level(AROUND) > 0, "link": link})
    tok = tok.withColumn("thin", F.col("link") | F.col("around"))
    return tok.withColumns({"text_sum": F.sum("text").over(_so_far()), "thin_sum": F.sum(F.when(F.col("thin"), F.col("text")).otherwise(0)).over(_so_far())})


def with_nodes(tok: DataFrame) -> DataFrame:
    """Adds ``node_end``, ``node_text`` and ``node_thin`` to the opening tags of containers: where they end and what they hold."""
    own = F.col("name").isin(CONTAINERS) & (F.col("opens") | F.col("closes"))
    tok = tok.withColumn("node_depth", F.when(own & F.col("opens"), F.col("depth")).when(own, F.col("depth") + 1))
    siblings, whole = Window.partitionBy("page", "node_depth").orderBy("pos"), Window.partitionBy("page")
    opens = own & F.col("opens")
    at_end = lambda c: F.coalesce(F.lead(c).over(siblings), F.max(c).over(whole))
    return tok.withColumns({
        "node_end": F.when(opens, F.coalesce(F.lead("pos").over(siblings), F.lit(_END))),
        "node_text": F.when(opens, at_end("text_sum") - F.col("text_sum")),
        "node_thin": F.when(opens, at_end("thin_sum") - F.col("thin_sum")),
    })


def nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page, pos, name, depth, node_end, node_text, node_thin) of every container of every distinct page."""
    return with_nodes(measured(tokens(pages, html))).filter("node_end is not null").select("page", "pos", "name", "depth", "node_end", "node_text", "node_thin")


def main_content(tok: DataFrame) -> DataFrame:
    """The tokens of each page's main content: of its first article or main element that has text; else of the container with the best
    balance of its own text, squared, to all its text, the deepest of equals; else of the page. What goes around it is left out."""
    good = F.col("node_text") - F.col("node_thin")
    marked = F.col("name").isin(MAIN) & (F.col("node_text") > 0)
    score = F.when(marked, 0).otherwise(F.floor(good * good / F.greatest("node_text", F.lit(1))))
    found = F.when(F.col("node_end").isNotNull() & (marked | (good > 0)), F.struct(_when(marked).otherwise(0).alias("marked"), score.cast("long").alias("score"), F.when(marked, 0).otherwise(F.col("depth")).alias("depth"), (-F.col("pos")).alias("before"), "node_end", "around"))
    tok = tok.withColumn("best", F.max(found).over(Window.partitionBy("page")))
    inside = F.col("best").isNull() | F.col("pos").between(-F.col("best.before"), F.col("best.node_end"))
    return tok.filter(inside & (F.coalesce("best.around", F.lit(False)) | ~F.col("around"))).drop("best")


def _lines(tok: DataFrame) -> DataFrame:
    """(page, line, gap, text) of the lines with content, laid out."""
    is_, opens, name = F.col("name").isin, F.col("opens"), F.col("name")
    level = F.regexp_extract("name", "^h([1-6])$", 1).try_cast("int")
    href, src = F.regexp_extract("tok", attribute_pattern("href"), 1), F.regexp_extract("tok", attribute_pattern("src"), 1)
    tok = tok.withColumns({
        "lists": _level(["ul", "ol"]), "quotes": _level(["blockquote"]), "pre": _level(["pre"]) > 0, "tables": _level(["table"]),
        "heading": F.coalesce(F.last(F.when(level.isNotNull(), F.when(opens, level).otherwise(0)), True).over(_so_far()), F.lit(0)),
        "href": F.coalesce(F.last(F.when((name == "a") & opens, href), True).over(_so_far()), F.lit("")),
        "table": F.last(F.when((name == "table") & opens, F.col("pos")), True).over(_so_far()),
    })
    tok = tok.withColumn("list", F.last(F.when(is_(["ul", "ol"]) & opens, F.col("pos")), True).over(_so_far("lists"))).withColumn("kind", F.last(F.when(is_(["ul", "ol"]) & opens, name), True).over(_so_far("lists")))
    tok = tok.withColumn("number", F.sum(F.when((name == "li") & opens, 1).otherwise(0)).over(_so_far("list")))
    item = F.when((name == "li") & opens, F.struct("pos", "kind", "number"))
    shown = F.translate(F.regexp_replace("body", f"[{SPACE}]+", " "), "\r", "")
    nested = F.col("lists") > F.when(F.col("closes"), 0).otherwise(1)
    cell = (F.col("tables") > 0) & ~is_(["table", "tr"])
    gap = F.when(cell | (F.col("pre") & ~is_(["pre"])), 0).when(name == "br", 1).when(is_(LINES), 2).when(is_(["ul", "ol"]), F.when(nested, 2).otherwise(3)).when(is_(BLOCKS), 3).otherwise(0)
    linked = (F.col("href") != "") & ~F.col("href").startswith("#")
    image = (name == "img") & (src != "")
    wrapped = F.lit("")
    for tag, mark in WRAPPED.items():
        wrapped = F.when(name == tag, F.lit(mark)).otherwise(wrapped)
    tok = tok.withColumns({
        "item": F.last(item, True).over(_so_far()),
        "gap": gap,
        "content": (F.col("text") > 0) | image,
        "shown": F.when(name == "", F.when(F.col("pre"), F.col("body")).otherwise(shown)).when(image, F.concat(F.lit("!["), F.regexp_extract("tok", alt_pattern(), 1), F.lit("]("), src, F.lit(")"))).when((name == "code") & ~F.col("pre"), "`").when((name == "a") & linked & opens, "[").when((name == "a") & linked & F.col("closes"), F.concat(F.lit("]("), F.col("href"), F.lit(")"))).when(cell & is_([*BLOCKS, *LINES, "br"]), " ").otherwise(wrapped),
    })
    tok = tok.withColumn("line", F.sum(_when(F.col("gap") > 0).otherwise(0)).over(_so_far()))
    before = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tok = tok.withColumns({"held": F.max(F.when(F.col("content"), F.col("pos"))).over(before), "cells": F.sum(F.when(is_(["td", "th"]) & opens, 1).otherwise(0)).over(_so_far("line"))})
    pending = F.col("item.pos") > F.coalesce("held", F.lit(-1))
    marker = F.when((F.col("lists") > 0) & pending, F.when(F.col("item.kind") == "ol", F.concat(F.col("item.number").cast("string"), F.lit(". "))).otherwise("* ")).when(F.col("lists") > 0, "  ").otherwise("")
    prefix = F.concat(F.repeat(F.lit("> "), F.greatest("quotes", F.lit(0)).cast("int")), F.repeat(F.lit("  "), F.greatest("lists", F.lit(0)).cast("int")), marker, F.when(F.col("heading") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "))).otherwise(""))
    first = F.min(F.when(F.col("content"), F.struct("pos", prefix.alias("prefix"), "pre", F.when(F.col("tables") > 0, F.col("table")).alias("table")))).alias("first")
    piece = F.struct("pos", F.when(is_(["td", "th"]) & opens, F.when(F.col("cells") > 1, " | ").otherwise("")).otherwise(F.col("shown")).alias("shown"))
    lines = tok.groupBy("page", "line").agg(F.max("gap").alias("gap"), first, F.max("cells").alias("cells"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    order = Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("block", F.count("first").over(order))
    lines = lines.withColumn("gap", F.max("gap").over(Window.partitionBy("page", "block"))).filter("first is not null")
    text = F.array_join(F.transform("pieces", lambda p: p["shown"]), "")
    flat = F.trim(F.regexp_replace(text, " {2,}", " "))
    held = F.regexp_replace(F.regexp_replace(text, "^\n+|\\s+$", ""), "(?m)^", "    ")
    top = F.min(F.when(F.col("cells") > 0, F.col("line"))).over(Window.partitionBy("page", "first.table"))
    ruled = F.col("first.table").isNotNull() & (F.col("cells") > 0) & (F.col("line") == top)
    rule = F.when(ruled, F.concat(F.lit("\n"), F.repeat(F.lit("---|"), F.col("cells").cast("int") - 1), F.lit("---"))).otherwise("")
    return lines.select("page", "line", "gap", F.concat("first.prefix", F.when(F.col("first.pre"), held).otherwise(flat), rule).alias("text"))


def markdown_of(tok: DataFrame) -> DataFrame:
    """(page, markdown): lines joined by a line end, or two between blocks; a break within a block leaves two blanks."""
    joint = F.when(F.col("gap") == 3, "\n\n").when(F.col("gap") == 2, "\n").otherwise("  \n")
    lines = _lines(tok).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("line", joint.alias("joint"), "text"))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(x["joint"], x["text"]))), "")
    return lines.select("page", joined.alias("markdown"))


def to_markdown(df: DataFrame, html: str = "html", into: str = "markdown", readable: bool = False) -> DataFrame:
    """Adds ``into``: the page as markdown, or with ``readable`` its main content under its title; empty where a page says nothing,
    null for a null page. Entities are decoded once, in texts."""
    tok = tokens(df, html)
    if readable:
        tok = main_content(with_nodes(measured(tok)))
    out = markdown_of(tok).select(F.col("page").alias("_page"), F.col("markdown").alias("_markdown"))
    df = df.withColumn("_digest", F.sha2(F.col(html).cast("binary"), 256))
    df = df.join(out, F.col("_digest") == F.col("_page"), "left")
    body = F.when(F.col(html).isNotNull(), F.coalesce("_markdown", F.lit("")))
    if readable:
        df = ht.decoded(df.withColumn("_title", ht.raw_title(F.col(html))), "_title")
        heading = F.trim(F.regexp_replace("_title", f"[{SPACE}]+", " "))
        body = F.when((heading == "") | (body == "") | body.startswith("# "), body).otherwise(F.concat(F.lit("# "), heading, F.lit("\n\n"), body))
    return df.withColumn(into, body).drop("_digest", "_page", "_markdown", "_title")
