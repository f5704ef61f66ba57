"""From places in a normalised text back to the text as it stands.

Normalisation changes lengths: NFKC joins and splits letters, invisible characters go, white space collapses, ends are
trimmed. Where nothing of that happens, both texts run beside each other; so a text's map is a list of runs, each with its
start in either text, and a place is looked up by binary search. Only stretches that normalisation may change are read letter by letter.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _STABLE, INVISIBLE, SPACE

_PLACES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _python(chars: str) -> str:
    return re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]:0>4}", chars)


_WHITE = re.compile(f"[{_python(SPACE)}]")
#: Characters that stay as they are and are no white space; lower case makes two letters of U+0130.
_SOLID = r"\x00-\x08\x0e-\x1b!-\x7f" + _python(_STABLE).removeprefix(r"\x00-\x7f").replace("\\u0131", "\\u012f\\u0131")
#: White space and characters that may change; single blanks between solid characters are passed over.
_STRETCH = re.compile(rf"[^{_SOLID}](?:(?<! )|(?<=\A )|(?=[^{_SOLID}]|\Z))[^{_SOLID}]*")


@cache
def _seconds() -> frozenset[str]:
    """Letters that may join the one before although they are no marks: second parts of composed letters, Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(i)).split() for i in range(sys.maxunicode + 1))
    return frozenset({chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"} | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))))


@cache
def _joins(letter: str) -> bool:
    first = unicodedata.normalize("NFKD", letter)[0]
    return bool(unicodedata.combining(first)) or first in _seconds()


def _letters(text: str, low: int, high: int) -> list[tuple[bool, int, int]]:
    """(is white space, start, end) of what each character of ``text[low:high]`` after NFKC and without invisible ones stands for."""
    out, at = [], low
    while at < high:
        end = at + 1
        while end < high and _joins(text[end]):
            end += 1
        for c in unicodedata.normalize("NFKC", text[at:end]):
            if c not in INVISIBLE:
                out += [(bool(_WHITE.match(c)), at, end)] * len(c.lower())
        at = end
    return out


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, start, size) by place ``at`` in the normalised text: from there on each character stands for one of ``text`` from ``start``
    on (size 0), or a single one stands for the ``size`` characters from ``start`` on. The last run is empty, at the end."""
    out: list[tuple[int, int, int]] = []
    n = done = 0
    for m in _STRETCH.finditer(text):
        low = max(m.start() - 1, done)  # with the character before, a base for marks
        if low > done:
            out.append((n, done, 0))
            n += low - done
        done = m.end()
        white = None
        for blank, start, end in _letters(text, low, done):
            if blank:
                white = (white[0] if white else start, end)
                continue
            if white and n:
                out.append((n, white[0], white[1] - white[0]))
                n += 1
            white = None
            out.append((n, start, end - start))
            n += 1
        if white and n and done < len(text):
            out.append((n, white[0], white[1] - white[0]))
            n += 1
    if done < len(text):
        out.append((n, done, 0))
        n += len(text) - done
    out.append((n, len(text), 0))
    at, start, size = (np.array(c, np.int64) for c in zip(*out, strict=True))
    return at, start, size


def original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of ``text`` that spans of its normalised form stand for."""
    at, start, size = runs(text)

    def edge(place: int, end: bool) -> int:
        k = int(np.searchsorted(at, place, "right")) - 1
        if size[k]:
            return int(start[k] + (size[k] if end else 0))
        return int(start[k] + place - at[k] + end)

    return [(edge(a, False), edge(b - 1, True)) for a, b in spans if b > a]


@F.pandas_udf(_PLACES)
def _original(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text: str | None, found: list | None) -> list | None:
        if text is None or found is None or not len(found):
            return None
        return [{"start": a, "end": b} for a, b in original(text, [(s["start"], s["end"]) for s in found])]

    return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def original_spans(text: Column, spans: Column) -> Column:
    """``spans`` of the normalised text as spans of ``text``; null where there are none, so other rows cost nothing."""
    return _original(F.when(F.size(spans) > 0, text), F.when(F.size(spans) > 0, spans))
