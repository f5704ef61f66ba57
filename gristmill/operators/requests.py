"""Request and response chains of stages; a stage is a function of DataFrames with a name and a gate."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import secrets as sec
from . import actions, pages


def secret_decisions(requests: DataFrame, allow: list[str] | DataFrame | None = None, override: bool = False, secrets: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``rule``, ``location``, ``action`` and ``reason``; requests (url, headers, body, args). Blocked rows stay, with their reason.

    ``allow`` is a short list of domains, or a table (domain) of any size.
    """
    headers = F.transform(F.map_entries(F.map_filter("headers", lambda k, _: F.lower(k) != "authorization")), lambda e: e["value"])
    places = {
        "URL": F.coalesce(sec.first_secret(F.col("url"), secrets), sec.first_of(sec.query_values(F.col("url")), secrets)),
        "headers": sec.first_of(headers, secrets),
        "body": F.when(F.col("body") != "", sec.first_secret(F.col("body"), secrets)),
        "arguments": sec.first_of(F.col("args"), secrets),
    }
    found = F.coalesce(*[F.when(r.isNotNull(), F.struct(r.alias("rule"), F.lit(p).alias("location"))) for p, r in places.items()])
    if isinstance(allow, DataFrame):
        requests = sec.with_allowed(requests, allow, into="_allowed")
    skip = F.lit(override) | (F.col("_allowed") if isinstance(allow, DataFrame) else sec.allowed(F.col("url"), allow or []))
    df = requests.withColumn("found", F.when(~skip, found)).withColumn("rule", F.col("found.rule")).withColumn("location", F.col("found.location")).drop("found", "_allowed")
    blocked = F.col("rule").isNotNull()
    return df.withColumn("action", F.when(blocked, "block").otherwise("pass")).withColumn("reason", F.when(blocked, F.concat(F.lit("secret in "), F.col("location"), F.lit(": "), F.col("rule"))))


@dataclass(frozen=True)
class Stage:
    """``change`` gives the new body and content type (null keeps the last) where ``gate`` holds; it sees null elsewhere.

    ``rows`` does the same to whole rows, for stages that are no expression: it gives ``output`` and ``new_type``.
    """

    slug: str
    gate: Callable[[], Column]
    change: Callable[[Column], tuple[Column, Column | None]] | None = None
    rows: Callable[[DataFrame], DataFrame] | None = None


def is_html() -> Column:
    return F.coalesce(F.lower("content_type"), F.lit("")).contains("text/html")


def is_text() -> Column:
    return F.coalesce(F.lower("content_type"), F.lit("")).rlike("text/(markdown|plain|html)")


def is_json() -> Column:
    return F.coalesce(F.lower("content_type"), F.lit("")).rlike("(application|text)/json")


def response_chain(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Stages in order over (body, content_type)."""

    def apply(df: DataFrame, s: Stage) -> DataFrame:
        gate = s.gate()
        if s.rows:
            columns = df.columns
            out = s.rows(df.withColumn("input", F.when(gate, F.col("body"))))
            body, kind = F.coalesce("output", "body"), F.coalesce("new_type", "content_type")
            return out.withColumns({"body": F.when(gate, body).otherwise(F.col("body")), "content_type": F.when(gate, kind).otherwise(F.col("content_type"))}).select(*columns)
        body, kind = s.change(F.when(gate, F.col("body")))
        new_kind = F.col("content_type") if kind is None else F.coalesce(kind, F.col("content_type"))
        return df.withColumns({"body": F.when(gate, body).otherwise(F.col("body")), "content_type": F.when(gate, new_kind).otherwise(F.col("content_type"))})

    return reduce(apply, stages, df)


def request_chain(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stages may set ``action`` to ``block`` with a ``why``, or change columns. What they do to rows blocked before them is undone:
    such rows keep the values they had when they were blocked."""
    df = df.withColumn("blocked_by", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    for stage in stages:
        name, columns = stage.__name__, [c for c in df.columns if c not in ("blocked_by", "reason")]
        held = df.withColumn("_before", F.when(F.col("blocked_by").isNotNull(), F.struct(*columns)))
        new = stage(held.withColumn("action", F.lit("pass")).withColumn("why", F.lit(None).cast("string")))
        done = F.col("_before").isNotNull()
        new = new.withColumns({c: F.when(done, F.col("_before")[c]).otherwise(F.col(c)) for c in columns})
        stop = ~done & (F.col("action") == "block")
        df = new.withColumn("reason", F.when(stop, F.col("why")).otherwise(F.col("reason"))).withColumn("blocked_by", F.when(stop, F.lit(name)).otherwise(F.col("blocked_by"))).drop("action", "why", "_before")
    return df.withColumn("action", F.when(F.col("blocked_by").isNotNull(), "block").otherwise("pass"))


def _indented(text: str, indent: int) -> str:
    try:
        return json.dumps(json.loads(text), indent=indent, ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def pretty_json(body: Column, indent: int = 2) -> Column:
    """Indented, letters as they are, keys in their order; what is no JSON, or is nested too deep to read, stays. Spark's own writer would sort the keys."""

    @F.pandas_udf(T.StringType())
    def pretty(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda t: _indented(t, indent), na_action="ignore")

    return pretty(body)


def json_stage(indent: int = 2) -> Stage:
    return Stage("json-prettify", is_json, lambda b: (pretty_json(b, indent), None))


def defender(threshold: float = 0.3, action: str = "redact", languages: list[str] | None = None) -> Stage:
    """Detection as a stage: a flagged body is rewritten, every judged body is wrapped; the gate is text."""

    def rows(df: DataFrame) -> DataFrame:
        found = actions.acted(actions.detect(df.withColumnRenamed("content_type", "old_type"), "input", threshold, languages=languages), "input", action, threshold)
        return found.withColumnRenamed("content_type", "new_type").withColumnRenamed("old_type", "content_type")

    return Stage("prompt-defender", is_text, rows=rows)


def markdown_stage(readable: bool = False) -> Stage:
    """HTML as markdown, or its main content; a page that says nothing stays as it is."""

    def rows(df: DataFrame) -> DataFrame:
        out = pages.to_markdown(df, "input", "output", readable)
        some = F.col("output") != ""
        return out.withColumn("new_type", F.when(some, F.lit("text/markdown"))).withColumn("output", F.when(some, F.col("output")))

    return Stage("readability" if readable else "markdown", is_html, rows=rows)


MARKDOWN, READABILITY = markdown_stage(), markdown_stage(readable=True)
JSON = json_stage()
#: Response stages in order, and whether they run unless they are disabled; the others run if they are enabled.
REGISTRY = {"readability": (MARKDOWN, True), "json-prettify": (JSON, False), "prompt-defender": (defender(), True)}


def enabled(disable: set[str] = frozenset(), raw: bool = False, enable: set[str] = frozenset(), readable: bool = False, threshold: float = 0.3, action: str = "redact", languages: list[str] | None = None) -> list[Stage]:
    """Registered stages by default or by ``enable``, without those disabled; none for raw output. ``readable`` keeps the main content only."""
    out = [] if raw else [stage for slug, (stage, default) in REGISTRY.items() if (default or slug in enable) and slug not in disable]
    own = {"readability": READABILITY if readable else MARKDOWN, "prompt-defender": defender(threshold, action, languages)}
    return [own.get(s.slug, own["readability"] if s is MARKDOWN else s) for s in out]


def process(df: DataFrame, disable: set[str] = frozenset(), enable: set[str] = frozenset(), allow: list[str] | DataFrame | None = None, **options: object) -> DataFrame:
    """Requests (url, headers, body, args) with their responses (response, content_type) through both chains.

    Adds ``action`` and ``reason``; a blocked request has no response. ``secret-defender`` is off if disabled, and enabling it
    overrides a finding, as on the command line.
    """
    if "secret-defender" in disable:
        df = df.withColumn("action", F.lit("pass")).withColumn("reason", F.lit(None).cast("string"))
    else:
        df = secret_decisions(df, allow, override="secret-defender" in enable).drop("rule", "location")
    passed = F.col("action") == "pass"
    df = df.withColumnRenamed("body", "request_body").withColumn("body", F.when(passed, F.col("response"))).withColumn("content_type", F.when(passed, F.col("content_type"))).drop("response")
    return response_chain(df, enabled(disable, enable=enable, **options)).withColumnsRenamed({"body": "response", "request_body": "body"})
