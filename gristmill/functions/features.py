"""Pattern features, scores and signals of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import may_match_ids
from .rules import CATEGORIES, ENGLISH, SHORT, WEIGHTS, Rule, java, may_match, on_normalized, rules, table_of, total_matches

WEIGHT_SUM = 15.5
THRESHOLD = 0.3


def density(text: Column, exprs: list[str]) -> Column:
    return F.least(total_matches(text, exprs) * F.lit(1000.0) / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def densities(text: Column, rules: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """By category; a category without rules has 0."""
    rules = ENGLISH if rules is None else rules
    return {c: density(text, rules.get(c, [])) for c in CATEGORIES}


#: Letters that match i and s without regard to case, although they are lower case themselves.
_FOLDED = ("\u0131\u017f", "is")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often and wherever it is used."""
    return F.transform(F.array(value), then)[0]


def latin_i(norm: Column) -> Column:
    """Letters that match i and s as these."""
    return F.when(norm.rlike(f"[{_FOLDED[0]}]"), F.translate(norm, *_FOLDED)).otherwise(norm)


def rule_hits(norm: Column, chosen: list[Rule] | None = None, ids: Column | None = None) -> Column:
    """(category, n) of each rule that matches in a normalised text; only rules whose anchors occur are run.

    ``ids`` are the numbers of these rules where one pass has found them (``anchor_ids``); else each anchor is looked for.
    """
    table = table_of(rules(["en"]) if chosen is None else chosen, "regex", on_normalized)
    run = (lambda t: may_match(t, table)) if ids is None else (lambda _: F.transform(ids, lambda i: F.get(table, i)))
    count = lambda t: F.transform(run(t), lambda r: F.struct(r["category"].alias("category"), F.regexp_count(t, r["expr"]).alias("n")))
    folded = once(norm, latin_i)
    return F.filter(once(folded, count), lambda r: r["n"] > 0)


#: Anchors from which on one pass over a text in Python costs less than looking for each of them.
MANY_ANCHORS = 128


def anchor_ids(norm: Column, chosen: list[Rule]) -> Column | None:
    """Numbers of the expressions that can match, from one pass for all anchors; None for few anchors."""
    anchors = [r.anchors for r in chosen if r.kind == "regex"]
    return may_match_ids(latin_i(norm), anchors) if sum(map(len, anchors)) > MANY_ANCHORS else None


def motif_hits(norm: Column, chosen: list[Rule] | None = None) -> Column:
    """(category, n) of each motif that occurs: its places in the text, each once."""
    table = table_of(rules(["en"]) if chosen is None else chosen, "motif", lambda r: r.expr.lower())
    count = lambda t, m: ((F.length(t) - F.length(F.replace(t, m["expr"], F.lit("")))) / F.length(m["expr"])).cast("int")
    return once(norm, lambda t: F.transform(F.filter(table, lambda m: F.contains(t, m["expr"])), lambda m: F.struct(m["category"].alias("category"), count(t, m).alias("n"))))


def total_of(hits: Column, category: str | None = None) -> Column:
    own = hits if category is None else F.filter(hits, lambda r: r["category"] == category)
    return F.coalesce(F.aggregate(own, F.lit(0), lambda s, r: s + r["n"]), F.lit(0))  # a null text has no hits


def densities_of(hits: Column, length: Column) -> dict[str, Column]:
    return {c: F.least(total_of(hits, c) * F.lit(1000.0) / F.greatest(length, F.lit(1)), F.lit(1.0)) for c in CATEGORIES}


def _per_char(count: Column, text: Column) -> Column:
    return count / F.greatest(F.length(text), F.lit(1))


def statistics(text: Column) -> dict[str, Column]:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    solid = F.length(F.regexp_replace(text, r"[ \t-\r]", ""))
    n_words = F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    return {
        "text_length": F.least(F.length(text) / 10000, F.lit(1.0)),
        "special_char_ratio": _per_char(F.length(F.regexp_replace(text, r"[\p{L}\p{N} \t-\r]", "")), text),
        "caps_ratio": F.when(letters > 0, upper / letters).otherwise(0.0),
        "newline_density": _per_char(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), text),
        "avg_word_length": F.when(n_words > 0, F.least(solid / n_words / 20, F.lit(1.0))).otherwise(0.0),
    }


def with_vector(df: DataFrame, norm: str = "norm_text", into: str = "features") -> DataFrame:
    """Adds the twelve features of a normalised text, in their order; its rules are run once."""
    df = df.select("*", F.inline(F.array(F.struct(rule_hits(F.col(norm)).alias("_hits")))))
    own = densities_of(F.col("_hits"), F.length(norm))
    return df.withColumn(into, F.array(*own.values(), *statistics(F.col(norm)).values())).drop("_hits")


def base_score(features: dict[str, Column]) -> Column:
    total = sum((features[c] * WEIGHTS[c] for c in CATEGORIES), F.lit(0.0))
    return F.least(total / WEIGHT_SUM, F.lit(1.0))


def motif_boost(motif_density: Column) -> Column:
    return F.least(motif_density / 10, F.lit(0.3))


def final_score(base: Column, motif_density: Column) -> Column:
    return F.least(base + motif_boost(motif_density), F.lit(1.0))


def signals(features: dict[str, Column]) -> Column:
    """Short codes of the active categories, or ``semantic``."""
    codes = F.concat_ws(",", *[F.when(features[c] > 0, F.lit(SHORT[c])) for c in CATEGORIES])
    return F.when(codes == "", F.lit("semantic")).otherwise(codes)


def signal_list(features: dict[str, Column]) -> Column:
    """(name, score rounded to four places) of the active categories."""
    each = F.array(*[F.when(features[c] > 0, F.struct(F.lit(c).alias("name"), F.round(features[c], 4).alias("score"))) for c in CATEGORIES])
    return F.filter(each, lambda x: x.isNotNull())


def matches(norm: Column, chosen: list[Rule] | None = None) -> Column:
    """Category to the matched strings of a normalised text, without empty categories; only rules whose anchors occur are run."""
    table = table_of(rules(["en"]) if chosen is None else chosen, "regex", on_normalized)
    found = lambda t: F.transform(may_match(t, table), lambda r: F.struct(r["category"].alias("category"), F.regexp_extract_all(t, r["expr"], F.lit(0)).alias("found")))
    of = lambda all_, c: F.struct(F.lit(c).alias("key"), F.flatten(F.transform(F.filter(all_, lambda x: x["category"] == c), lambda x: x["found"])).alias("value"))
    pairs = once(once(norm, lambda t: found(latin_i(t))), lambda all_: F.filter(F.array(*[of(all_, c) for c in CATEGORIES]), lambda p: F.size(p["value"]) > 0))
    return F.map_from_entries(pairs)
