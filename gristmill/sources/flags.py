"""The options of a command line, told apart from the arguments that are passed on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("warn", "redact", "datamark", "metadata", "silent")
SWITCHES = {"--raw": "raw", "--render": "render", "--readability": "readability", "--list-middleware": "list"}
#: Options that take the next argument as their value.
VALUED = {"--disable": "disable", "--enable": "enable", "--injection-threshold": "threshold", "--injection-action": "action", "--injection-languages": "languages", "--injection-method": "method"}
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_NONE = "cast(array() as array<string>)"


def extract_flags(args: Column) -> Column:
    """(raw, render, readability, list, help, disable, enable, threshold, action, languages, method, remaining) as one fold.

    A value that is no number or no action keeps what was set before; help counts in the first place only;
    ``--disable`` and ``--enable`` without a value are passed on, other options without one are dropped.
    Null arguments give null.
    """
    fields = {
        **{k: F.lit(False) for k in (*SWITCHES.values(), "help")},
        "disable": F.expr(_NONE),
        "enable": F.expr(_NONE),
        "threshold": F.lit(None).cast("double"),
        "action": F.lit(None).cast("string"),
        "languages": F.lit(None).cast("array<string>"),
        "method": F.lit(None).cast("string"),
        "remaining": F.expr(_NONE),
        "pending": F.lit(""),
        "first": F.lit(True),
    }

    def step(s: Column, a: Column) -> Column:
        free = s["pending"] == ""
        takes = lambda k: s["pending"] == k
        codes = F.filter(F.transform(F.split(F.lower(a), ","), lambda x: F.trim(x)), lambda x: x != "")
        is_help = free & s["first"] & a.isin("--help", "-h")
        options = F.create_map(*[F.lit(x) for pair in VALUED.items() for x in pair])
        passed = free & ~a.isin(*SWITCHES, *VALUED) & ~is_help
        new = {
            **{k: s[k] | (free & (a == flag)) for flag, k in SWITCHES.items()},
            "help": s["help"] | is_help,
            **{k: F.when(takes(k), F.array_union(s[k], F.array(a))).otherwise(s[k]) for k in ("disable", "enable")},
            "threshold": F.when(takes("threshold") & a.rlike(NUMBER), F.trim(a).try_cast("double")).otherwise(s["threshold"]),
            "action": F.when(takes("action") & F.lower(a).isin(*ACTIONS), F.lower(a)).otherwise(s["action"]),
            "languages": F.when(takes("languages"), codes).otherwise(s["languages"]),
            "method": F.when(takes("method"), a).otherwise(s["method"]),
            "remaining": F.when(passed, F.concat(s["remaining"], F.array(a))).otherwise(s["remaining"]),
            "pending": F.when(free, F.coalesce(options[a], F.lit(""))).otherwise(F.lit("")),
            "first": F.lit(False),
        }
        return F.struct(*[new[k].alias(k) for k in fields])

    def finish(s: Column) -> Column:
        left = F.when(s["pending"].isin("disable", "enable"), F.concat(s["remaining"], F.array(F.concat(F.lit("--"), s["pending"])))).otherwise(s["remaining"])
        return F.struct(*[(left if k == "remaining" else s[k]).alias(k) for k in fields if k not in ("pending", "first")])

    start = F.struct(*[c.alias(k) for k, c in fields.items()])
    return F.aggregate(F.transform(args, lambda a: F.coalesce(a, F.lit(""))), start, step, finish)
