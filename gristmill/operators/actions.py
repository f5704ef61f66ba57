"""Detection end to end, and what is done to a flagged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as feats
from ..functions import spans as sp
from ..functions import text as tx
from ..functions.positions import original_spans
from ..functions.rules import CATEGORIES, Rule
from ..functions.rules import rules as rules_of

ACTIONS = ("warn", "redact", "datamark", "metadata", "silent")


def detect(df: DataFrame, text: str = "text", threshold: float | Column = feats.THRESHOLD, nfkc: bool = True, languages: list[str] | None = None, rules: list[Rule] | None = None, fuzzy: str | None = None) -> DataFrame:
    """Adds ``norm_text``, seven densities, ``motif_density``, ``score``, ``suspicious``, ``flagged`` and ``signals``.

    The rules are those of ``languages`` (English; ``["all"]`` for every language), or ``rules`` as given, such as those of files
    (``rules.from_files``). ``fuzzy`` names a unique key column: motifs then count as well where they occur misspelt, and ``_misspelt``
    keeps where, for ``acted``.
    ``threshold`` may be a column. Without any density the fast path holds: never flagged, at any threshold.
    """
    from .motifs import fuzzy_hits

    chosen = rules if rules is not None else rules_of(languages or ["en"])
    df = tx.normalized(df, text) if nfkc else df.withColumn("norm_text", tx.plain_normalized(F.col(text)))
    norm = F.col("norm_text")
    # a count by place, each place once: windows of a text overlap, occurrences do not
    if fuzzy:
        df = df.withColumn("_misspelt", fuzzy_hits(F.lower(norm), chosen=chosen))
    motifs = F.when(norm.isNotNull(), F.size("_misspelt")).otherwise(0) if fuzzy else feats.total_of(feats.motif_hits(norm, chosen))
    ids = feats.anchor_ids(norm, chosen)
    if ids is not None:
        df = df.withColumn("_ids", ids)
    found = F.struct(feats.rule_hits(norm, chosen, None if ids is None else F.col("_ids")).alias("_hits"), motifs.alias("_motifs"), F.length(norm).alias("_length"))
    # as generated rows: a later filter on the verdict is not pushed below, where it would run the rules again
    df = df.select("*", F.inline(F.array(found)))
    df = df.withColumns(feats.densities_of(F.col("_hits"), F.col("_length")))
    df = df.withColumn("motif_density", F.when(F.col("_length") >= 10, F.col("_motifs") * 1000.0 / F.col("_length")).otherwise(0.0)).drop("_hits", "_motifs", "_length", "_ids")
    named = {c: F.col(c) for c in CATEGORIES}
    df = df.withColumn("score", feats.final_score(feats.base_score(named), F.col("motif_density")))
    suspicious = sum((F.when(c > 0, 1).otherwise(0) for c in [*named.values(), F.col("motif_density")]), F.lit(0)) > 0
    return df.withColumn("suspicious", suspicious).withColumn("flagged", suspicious & (F.col("score") >= threshold)).withColumn("signals", feats.signals(named))


def masked_spans(df: DataFrame, text: str, rules: list[Rule] | None = None, fuzzy: str | None = None) -> DataFrame:
    """Adds ``merged``: what to mask in the flagged rows of ``detect``, null for other rows.

    That is every match of expressions and motifs in the text as it stands, and every stretch of it that a match
    in its normalised form stands for, so that what was flagged in disguise is masked too. ``fuzzy`` names the key column:
    motifs that occur misspelt count as well, where ``detect`` has found them.
    """
    from .motifs import HITS, fuzzy_hits

    flagged = F.col("flagged")
    # generated rows: what follows names the spans more than once, and they are found once
    found = F.struct(F.when(flagged, sp.norm_spans(F.col("norm_text"), rules)).alias("_norm_spans"), F.when(flagged, sp.rule_spans(F.col(text), rules)).alias("_raw_spans"))
    df = df.select("*", F.inline(F.array(found)))
    if fuzzy:
        place = lambda h: F.struct(F.greatest(h["position"], F.lit(0)).alias("start"), F.least(h["position"] + h["length"], F.length("norm_text")).alias("end"))
        if "_misspelt" not in df.columns:
            df = df.withColumn("_misspelt", fuzzy_hits(F.when(flagged, F.lower("norm_text")), chosen=rules))
        within = F.array_distinct(F.transform(F.coalesce("_misspelt", F.array().cast(HITS)), place))
        df = df.withColumn("_norm_spans", F.when(flagged, F.concat("_norm_spans", within))).drop("_misspelt")
    df = df.withColumn("_mapped", original_spans(F.col(text), F.col("_norm_spans")))
    both = F.concat("_raw_spans", F.coalesce("_mapped", F.array().cast(sp.SPANS)))
    return df.withColumn("merged", F.when(flagged, sp.merge(F.sort_array(F.array_distinct(both))))).drop("_norm_spans", "_raw_spans", "_mapped")


def acted(df: DataFrame, text: str = "text", action: str | Column = "redact", threshold: float | Column = feats.THRESHOLD, rules: list[Rule] | None = None, fuzzy: str | None = None) -> DataFrame:
    """Adds ``output`` and ``content_type`` to the rows of ``detect``. An unknown action warns; a null text counts as empty.

    Action and threshold may be columns: each row its own.

    What is redacted, and told by ``metadata``, are the spans of ``masked_spans``.
    """
    chosen = action if isinstance(action, Column) else F.lit(action)
    used = set(ACTIONS) if isinstance(action, Column) else {action if action in ACTIONS else "warn"}
    body = F.coalesce(F.col(text), F.lit(""))
    plain = sp.wrapped(body)
    if used & {"redact", "metadata"}:
        df = masked_spans(df, text, rules, fuzzy)
    shown = {"redact": lambda: sp.redact(body, F.col("merged")), "datamark": lambda: sp.datamark(body)}
    changed = sp.wrapped(sp.tagged(_chosen(chosen, {k: f() for k, f in shown.items() if k in used}, body), F.col("score"), F.col("signals")))
    if "silent" in used:
        changed = F.when(chosen == "silent", plain).otherwise(changed)
    kind = F.lit(None).cast("string")
    if "metadata" in used:
        changed = F.when(chosen == "metadata", metadata(body, threshold)).otherwise(changed)
        kind = F.when(F.col("flagged") & (chosen == "metadata"), F.lit("application/json"))
    return df.withColumn("output", F.when(F.col("flagged"), changed).otherwise(plain)).withColumn("content_type", kind)


def _chosen(action: Column, by_action: dict[str, Column], other: Column) -> Column:
    for name, value in by_action.items():
        other = F.when(action == name, value).otherwise(other)
    return other


def metadata(text: Column, threshold: float | Column) -> Column:
    """The text and what was found in it as JSON, from the columns of ``detect`` and ``masked_spans``."""
    features = F.struct(*[F.round(F.col(c), 4).alias(c) for c in CATEGORIES])
    analysis = F.struct(F.round("score", 4).alias("score"), (threshold if isinstance(threshold, Column) else F.lit(threshold)).alias("threshold"), F.col("flagged").alias("flagged"), features.alias("pattern_features"), feats.matches(F.col("norm_text")).alias("matched_patterns"), F.col("merged").alias("matched_spans"), F.lit("pattern-only").alias("mode"))
    return F.to_json(F.struct(text.alias("content"), analysis.alias("injection_analysis")), {"pretty": "true"})
