"""From HTML to text; markdown and the main content need a page's tree (``operators.pages``)."""

from __future__ import annotations

import html as html_table

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that end a line. There is no word boundary behind them, so longer names match as well.
BLOCK_TAGS = "p|div|br|hr|h[1-6]|li|tr|blockquote|pre|table|ul|ol|dl|dt|dd|section|article|header|footer|nav|main|aside|figure|figcaption"
#: Entities decoded without a UDF; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_INNER = r"[\t\x0b\x0c\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def looks_like_html(c: Column) -> Column:
    return c.rlike("<[a-zA-Z][^>]*>")


def drop_scripts(c: Column) -> Column:
    for tag in ("script", "style"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return c


def blocks_to_lines(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i)</?({BLOCK_TAGS})[^>]*>", "\n")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def decode_common_entities(c: Column) -> Column:
    for name, text in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(text))
    return c


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """The whole table, for texts with entities beyond the common ones."""
    return s.map(html_table.unescape, na_action="ignore")


def has_other_entities(c: Column) -> Column:
    """Named or numeric entities that ``decode_common_entities`` leaves."""
    common = "|".join(name[1:-1] for name in ENTITIES)
    return c.contains("&") & c.rlike(f"&(?!(?:{common});)(?:#|[A-Za-z])")


def decoded(df: DataFrame, column: str) -> DataFrame:
    """``column`` with all entities decoded; a UDF sees every row of a projection, texts of common entities only are nulls to it."""
    c = F.col(column)
    return df.withColumn(column, F.coalesce(decode_entities(F.when(has_other_entities(c), c)), decode_common_entities(c)))


def to_text(df: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """Blank to empty; HTML to text with all entities decoded; other text with its white space in order. A step over rows."""
    c = F.col(column)
    blank = ~F.coalesce(c, F.lit("")).rlike(r"[^ \t-\r]")
    is_html = ~blank & looks_like_html(c)
    stripped = F.when(blank, F.lit("")).when(is_html, strip_tags(blocks_to_lines(drop_scripts(c)))).otherwise(c)
    df = df.select("*", F.inline(F.array(F.struct(is_html.alias("_is_html"), stripped.alias("_stripped")))))
    text, html = F.col("_stripped"), F.col("_is_html")
    other = decode_entities(F.when(html & has_other_entities(text), text))
    df = df.withColumn(into, F.when(html, F.coalesce(other, decode_common_entities(text))).otherwise(text))
    return df.withColumn(into, collapse_lines(F.col(into))).drop("_is_html", "_stripped")


def collapse_lines(c: Column) -> Column:
    """Line ends as LF, runs of blanks as one, no blanks at a line's ends, two line ends at most."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, _INNER, " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def raw_title(c: Column) -> Column:
    """The title element's text as it stands, empty without one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1)
