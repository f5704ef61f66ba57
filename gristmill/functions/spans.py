"""Spans in code points, half open: finding, merging, rewriting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import latin_i, once
from .rules import Rule, java, may_match, on_normalized, rules, table_of

SPANS = "array<struct<start:int,end:int>>"
MARK = "\u2588"
DATA_MARK = "\ue000"


def _spans(text: Column, pattern: Column) -> Column:
    """Spans of all matches, from the lengths of what lies between the matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        low = s["at"] + x["gap"]
        return F.struct((low + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct(low.alias("start"), (low + x["size"]).alias("end")))).alias("out"))

    pairs = F.filter(F.zip_with(gaps, sizes, lambda g, m: F.struct(g.alias("gap"), m.alias("size"))), lambda x: x["size"].isNotNull())
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def regex_spans(text: Column, expr: str, prefix: bool = True) -> Column:
    pattern = java(expr) if prefix else expr
    return F.when(text.rlike(pattern), _spans(text, F.lit(pattern))).otherwise(F.array().cast(SPANS))


def all_spans(text: Column, exprs: list[str]) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.array(*[regex_spans(text, e) for e in exprs]))))


def rule_spans(text: Column, chosen: list[Rule] | None = None) -> Column:
    """Sorted spans of all expressions and motifs of ``chosen`` (English) in a text as it stands."""
    chosen = rules(["en"]) if chosen is None else chosen
    # white space differs from that of a normalised text: an anchor gives its longest word
    words = lambda r: tuple(max(a.split(" "), key=len) for a in r.anchors)
    motif = lambda r: "(?iU)" + re.escape(r.expr.lower()).replace(r"\ ", r"\s+")
    exprs = table_of(chosen, "regex", lambda r: java(r.expr), words)
    motifs = table_of(chosen, "motif", motif, lambda r: (max(r.expr.lower().split(" "), key=len),))
    some = F.transform(F.array(F.lower(text)), lambda t: may_match(t, F.concat(exprs, motifs)))[0]
    return F.sort_array(F.array_distinct(F.flatten(F.transform(some, lambda r: _spans(text, r["expr"])))))


def norm_spans(norm: Column, chosen: list[Rule] | None = None) -> Column:
    """As ``rule_spans`` in a normalised text, with the cheaper expressions that suffice there."""
    chosen = rules(["en"]) if chosen is None else chosen
    exprs = table_of(chosen, "regex", on_normalized)
    motifs = table_of(chosen, "motif", lambda r: "\\Q" + r.expr.lower() + "\\E", lambda r: (r.expr.lower(),))
    found = once(latin_i(norm), lambda t: F.flatten(F.transform(may_match(t, F.concat(exprs, motifs)), lambda r: _spans(t, r["expr"]))))
    return F.sort_array(F.array_distinct(found))


def merge(spans: Column) -> Column:
    """Overlapping and touching spans together; ``spans`` is sorted. They are evaluated once."""

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["start"] <= last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(spans, F.array().cast(SPANS), step)


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """Every character of the merged ``spans`` as ``mark``: the length stays. Pieces are joined once."""
    between = lambda low, high: F.substring(text, low + 1, high - low)

    def whole(cuts: Column) -> Column:
        before = lambda i: F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))
        pieces = F.transform(cuts, lambda x, i: F.concat(between(before(i), x["start"]), F.repeat(F.lit(mark), x["end"] - x["start"])))
        return F.concat(F.array_join(pieces, ""), between(before(F.size(cuts)), F.length(text)))

    return F.transform(F.array(spans), whole)[0]


def datamark(text: Column) -> Column:
    from .text import SPACE

    return F.regexp_replace(text, f"[{SPACE}]+", DATA_MARK)


def wrapped(text: Column) -> Column:
    return F.concat(F.lit("<untrusted>\n"), text, F.lit("\n</untrusted>"))


def tagged(text: Column, score: Column, signals: Column) -> Column:
    return F.concat(F.format_string('<suspected-prompt-injection p="%.2f" t="%s">\n', score, signals), text, F.lit("\n</suspected-prompt-injection>"))
