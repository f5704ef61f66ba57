"""Which rules can match a text: one pass for all their anchors, whatever their number."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shortest string that is worth looking for.
SHORTEST = 2
_parser = re._parser  # the tree of an expression, as Python reads it


def required(expr: str) -> tuple[str, ...]:
    """Strings in lower case of which every match of ``expr`` in a normalised text contains one; none if nothing can be said."""
    try:
        return _best(_parser.parse(expr)) or ()
    except re.error:
        return ()


def _best(tree) -> tuple[str, ...] | None:  # noqa: ANN001
    """The choice of strings, one of which must occur, whose shortest is longest."""
    found: list[tuple[str, ...]] = []
    run = ""
    for op, value in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL" and len(chr(value).lower()) == 1:
            run += chr(value).lower()
            continue
        if run:
            found.append((run,))
            run = ""
        inner = None
        if name == "SUBPATTERN":
            inner = _best(value[-1])
        elif name == "BRANCH":
            parts = [_best(branch) for branch in value[1]]
            inner = tuple(dict.fromkeys(x for part in parts for x in part)) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _best(value[2])
        if inner:
            found.append(inner)
    found = [x for x in found if min(map(len, x)) >= SHORTEST]
    return max(found, key=lambda x: min(map(len, x)), default=None)


@lru_cache(maxsize=8)
def _automaton(anchors: tuple[tuple[str, ...], ...]):  # noqa: ANN202
    import ahocorasick

    rules: dict[str, set[int]] = {}
    for i, own in enumerate(anchors):
        for a in own:
            rules.setdefault(a, set()).add(i)
    out = ahocorasick.Automaton()
    for a, of in rules.items():
        out.add_word(a, frozenset(of))
    if rules:
        out.make_automaton()
    return out, frozenset(i for i, own in enumerate(anchors) if not own)


def possible(text: str, anchors: tuple[tuple[str, ...], ...]) -> list[int]:
    """Numbers of the rules with an anchor in ``text``, or without any; the time grows with the text and its hits."""
    automaton, always = _automaton(anchors)
    out = set(always)
    if len(automaton):
        out.update(*{of for _, of in automaton.iter(text)})
    return sorted(out)


def may_match_ids(text: Column, anchors: list[tuple[str, ...]]) -> Column:
    """``possible`` of a column, as array<int>; null for null."""
    own = tuple(tuple(a) for a in anchors)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: possible(t, own), na_action="ignore")

    return find(text)
