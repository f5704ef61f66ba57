"""Motif matching over sliding windows, exact or fuzzy."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import once
from ..functions.rules import MOTIFS, Rule, rules, table_of

SIZE, STEP, SHORTEST, FUZZY_LEAST = 50, 25, 10, 75
LISTED = [(c, m) for c, ms in MOTIFS.items() for m in ms]


def windows(df: DataFrame, text: str = "text", size: int = SIZE, step: int = STEP, shortest: int = SHORTEST) -> DataFrame:
    """(…, pos, window): starts by ``step``; windows below ``shortest`` characters are left out."""
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("pos", F.explode(at)).withColumn("window", F.substring(F.col(text), F.col("pos") + 1, F.lit(size)))
    return out.filter(F.length("window") >= shortest)


def find_exact(df: DataFrame, key: str = "doc_id", text: str = "text", chosen: list[Rule] | None = None) -> DataFrame:
    """(key, motif, category, position, window_start, text_length, length, score) once per place: motifs that come first in some window of
    the text, and the first such window.

    Motifs are located in the whole text and windows follow by arithmetic: a motif is no longer than what two windows
    share, so it lies whole in the last window that starts at or before it, and perhaps in the one before.
    """
    rows = df.select(key, F.length(F.col(text)).alias("text_length"), F.inline(exact_hits(F.col(text), chosen)))
    return rows.withColumn("length", F.length("motif")).withColumn("score", F.lit(100.0))


def exact_hits(text: Column, chosen: list[Rule] | None = None) -> Column:
    """Array of (motif, category, position, window_start) of a text, as ``find_exact`` has them."""
    table = table_of(rules(["en"]) if chosen is None else chosen, "motif", lambda r: r.expr.lower())

    def places(t: Column, m: Column) -> Column:
        gaps = F.transform(F.split(t, F.concat(F.lit("\\Q"), m["expr"], F.lit("\\E")), -1), lambda g: F.length(g))
        size = F.length(m["expr"])
        starts = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), F.array().cast("array<int>"), lambda out, g: F.concat(out, F.array(F.coalesce(F.get(out, F.size(out) - 1) + size, F.lit(0)) + g)))
        pairs = once(starts, lambda all_: F.transform(all_, lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get(all_, i - 1), F.lit(-1)).alias("q"))))
        kept = F.filter(pairs, lambda x: _first_in_a_window(x["p"], x["q"], size, F.length(t)))
        return F.transform(kept, lambda x: F.struct(m["expr"].alias("motif"), m["category"].alias("category"), x["p"].alias("position"), _first_window(x["p"], x["q"], size).alias("window_start")))

    return once(F.lower(text), lambda t: F.flatten(F.transform(F.filter(table, lambda m: F.contains(t, m["expr"])), lambda m: places(t, m))))


def _first_window(place: Column, previous: Column, size: Column) -> Column:
    before = place - place % STEP - STEP
    return F.when((before >= 0) & (place + size <= before + SIZE) & (previous < before), before).otherwise(before + STEP)


def windows_with(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, motif, category, window_start) of every window that holds a motif whole, from the places of ``find_exact``: by arithmetic,
    no window is made."""
    last = F.col("position") - F.col("position") % STEP
    own = F.array(last - STEP, last)
    holds = lambda s: (s >= 0) & (F.col("position") + F.col("length") <= s + SIZE) & (F.col("text_length") - s >= SHORTEST)
    return found.select(key, "motif", "category", F.explode(F.filter(own, holds)).alias("window_start")).distinct()


def _first_in_a_window(place: Column, previous: Column, size: Column, length: Column) -> Column:
    """A window finds the first place in it; the last window of a text may be too short to count."""
    last = place - place % STEP
    before = last - STEP
    return ((length - last >= SHORTEST) & (previous < last)) | ((before >= 0) & (place + size <= before + SIZE) & (previous < before))


def partial_ratio(short: str, long: str) -> tuple[float, int]:
    """Best 200 * LCS / (m + k) of ``short`` against substrings of ``long`` no longer than it, and where.

    The row of the longest common subsequence is one integer (bit-parallel).
    """
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 0.0, 0
    m, best, at = len(short), 0.0, 0
    bits: dict[str, int] = {}
    for i, c in enumerate(short):
        bits[c] = bits.get(c, 0) | 1 << i
    full = (1 << m) - 1
    ends = [(s, min(s + m, len(long))) for s in range(len(long) - m + 1)] + [(0, k) for k in range(1, m)] + [(len(long) - k, len(long)) for k in range(1, m)]
    for low, high in ends:
        k = high - low
        if 200.0 * min(m, k) / (m + k) <= best:
            continue
        row = full
        for c in long[low:high]:
            u = row & bits.get(c, 0)
            row = ((row + u) | (row - u)) & full
        score = 200.0 * (m - row.bit_count()) / (m + k)
        if score > best:
            best, at = score, low
    return best, at


HITS = "array<struct<motif:string,category:string,position:int,length:int,score:double>>"
#: Characters that are read together; a longer text is read in pieces of so many.
_PIECE = 1 << 20


class _Alphabet:
    """The letters of the motifs as small numbers; 0 is any other character."""

    def __init__(self, listed: list[str]) -> None:
        self.letters = sorted(set("".join(listed)))
        self.number = {x: i for i, x in enumerate(self.letters, 1)}
        self.table = np.zeros(sys.maxunicode + 1, np.uint8 if len(self.letters) < 256 else np.uint16)
        for x, i in self.number.items():
            self.table[ord(x)] = i

    def codes(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _least_shared(size: int, least: float) -> int:
    """Letters that an alignment must share, where the two strings have ``size`` together, to reach ``least``."""
    return next((c for c in range(size + 1) if 200.0 * c / size >= least), size + 1)


class _Piece:
    """Texts laid out one behind the other, each from a multiple of ``STEP`` on, so that window w of all starts at w * ``STEP``."""

    def __init__(self, parts: list[tuple[int, int, str, int]], alphabet: _Alphabet) -> None:
        """``parts``: row, place of the part in its text, the part, and up to where windows start in it."""
        wide = [-(-len(t) // STEP) * STEP for _, _, t, _ in parts]
        base = np.concatenate([[0], np.cumsum(wide)]).astype(np.int64)
        self.alphabet, self.n = alphabet, int(base[-1])
        self.codes = np.zeros(self.n + 2 * SIZE, alphabet.table.dtype)
        for (_, _, t, _), low in zip(parts, base, strict=False):
            self.codes[low : low + len(t)] = alphabet.codes(t)
        per = base[1:] // STEP - base[:-1] // STEP
        part = np.repeat(np.arange(len(parts)), per)
        self.first = (base[:-1] // STEP)[part]
        self.starts = np.arange(self.n // STEP, dtype=np.int64) * STEP
        end = (base[:-1] + np.array([len(t) for _, _, t, _ in parts], np.int64))[part]
        own = self.starts - base[part] < np.array([w for _, _, _, w in parts], np.int64)[part]
        self.lengths = np.where(own, np.minimum(end - self.starts, SIZE), 0)
        self.rows = np.array([r for r, _, _, _ in parts], np.int64)[part]
        self.shift = np.array([at for _, at, _, _ in parts], np.int64)[part] - base[part]  # from a place here to one in the text
        self.ends = end
        held = np.flatnonzero(np.bincount(self.codes, minlength=len(alphabet.letters) + 1)[1:]) + 1
        self.sums = {int(x): np.concatenate([np.zeros(1, np.uint8), np.cumsum(self.codes == x, dtype=np.uint8)]) for x in held}  # differences below 256 are right
        rows = self.n // STEP + SIZE // STEP + 1
        self.by_step = {x: np.ascontiguousarray(c[: rows * STEP].reshape(rows, STEP).T) for x, c in self.sums.items()}  # [k][w]: the sum at k characters from window w's start
        self.bounds: dict[int, np.ndarray] = {}
        self.cut_off = np.flatnonzero(self.lengths < SIZE)  # windows that end with their text

    def most(self, count: int) -> np.ndarray:
        """``count`` everywhere: numpy compares bytes with an array many times faster than with a number."""
        if count not in self.bounds:
            self.bounds[count] = np.full(self.n, count, np.uint8)
        return self.bounds[count]

    def counts(self, motif: str) -> list[tuple[int, int]]:
        number = self.alphabet.number
        return [(number[x], motif.count(x)) for x in sorted(set(motif)) if number[x] in self.sums]

    def _shared(self, counts: list[tuple[int, int]], n: int, low: Callable[[int], np.ndarray], high: Callable[[int], np.ndarray]) -> np.ndarray:
        """Letters that the motif shares with each of ``n`` stretches, from the sums at their ends: no common subsequence is longer."""
        out, own = np.zeros(n, np.uint8), np.empty(n, np.uint8)
        for x, most in counts:
            if most == 1:
                np.not_equal(high(x), low(x), out=own.view(bool))
            else:
                np.subtract(high(x), low(x), out=own)
                np.minimum(own, self.most(most)[:n], out=own)
            np.add(out, own, out=out)
        return out

    def shared_at(self, counts: list[tuple[int, int]], m: int) -> np.ndarray:
        """By place: with the ``m`` characters from there on."""
        return self._shared(counts, self.n, lambda x: self.sums[x][: self.n], lambda x: self.sums[x][m : self.n + m])

    def shared_by_window(self, counts: list[tuple[int, int]], k: int, last: bool) -> np.ndarray:
        """By window: with its first or ``last`` ``k`` characters."""
        n = len(self.starts)
        at = lambda i: lambda x: self.by_step[x][i % STEP][i // STEP : i // STEP + n]
        if not last:
            return self._shared(counts, n, at(0), at(k))
        out, high = self._shared(counts, n, at(SIZE - k), at(SIZE)), (self.starts + self.lengths)[self.cut_off]
        low = np.maximum(high - k, 0)
        out[self.cut_off] = self._shared(counts, len(high), lambda x: self.sums[x][low], lambda x: self.sums[x][high])
        return out


def _aligned(piece: _Piece, motif: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, score) of the windows no shorter than ``motif`` whose ``partial_ratio`` with it reaches ``least``.

    Places, not windows, are aligned: a stretch of two windows is read once, and only where it shares letters enough.
    """
    m, counts, starts, lengths = len(motif), piece.counts(motif), piece.starts, piece.lengths
    fits = lengths >= max(m, SHORTEST)
    kind = np.uint32 if m < 32 else np.uint64
    full = kind((1 << m) - 1)
    bits, flipped = np.zeros(len(piece.alphabet.letters) + 1, kind), np.zeros(len(piece.alphabet.letters) + 1, kind)
    for i, x in enumerate(motif):
        bits[piece.alphabet.number[x]] |= kind(1 << i)
        flipped[piece.alphabet.number[x]] |= kind(1 << (m - 1 - i))

    def step(row: np.ndarray, letter: np.ndarray) -> np.ndarray:
        u = row & letter
        return ((row + u) | (row - u)) & full

    found = []  # window, place, score, rank: of equal scores in a window the least rank counts
    some = np.flatnonzero(piece.shared_at(counts, m) >= _least_shared(2 * m, least))
    own = some // STEP
    some, own = some[some + m <= piece.ends[own]], own[some + m <= piece.ends[own]]
    row = np.full(len(some), full)
    for t in range(m):
        row = step(row, bits[piece.codes[some + t]])
    score = 200.0 * (m - np.bitwise_count(row).astype(np.int64)) / (2 * m)
    hit = score >= least
    some, own, score = some[hit], own[hit], score[hit]
    for back in range(SIZE // STEP):
        w = own - back
        inside = (w >= piece.first[own]) & fits[w] & (some + m <= starts[w] + SIZE)
        found.append((w[inside], some[inside], score[inside], (some - starts[w])[inside]))
    shortest = next((k for k in range(1, m) if 200.0 * k / (m + k) >= least), m)
    together = 3
    for last, table in ((False, bits), (True, flipped)):
        may = np.zeros(len(starts), bool)
        for k in range(shortest, m, together):  # what the longest of some stretches shares bounds the others
            may |= piece.shared_by_window(counts, min(k + together, m) - 1, last) >= _least_shared(m + k, least)
        w = np.flatnonzero(may & fits)
        row, at, end = np.full(len(w), full), starts[w], starts[w] + lengths[w]
        for k in range(1, m if len(w) else 1):
            row = step(row, table[piece.codes[end - k if last else at + k - 1]])
            if k >= shortest:
                score = 200.0 * (m - np.bitwise_count(row).astype(np.int64)) / (m + k)
                hit = score >= least
                found.append((w[hit], (end - k if last else at)[hit], score[hit], np.full(int(hit.sum()), (2 if last else 1) * SIZE + k)))
    w, place, score, rank = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((rank, -score, w))
    w, place, score = w[order], place[order], score[order]
    best = np.flatnonzero(np.diff(w, prepend=-1))
    return w[best], place[best], score[best]


def _short_windows(piece: _Piece, motif: str, least: float, texts: list[str]) -> list[tuple[int, int, float]]:
    """As ``_aligned``, of the windows shorter than ``motif``, which a text ends with: few, each aligned by itself where letters allow."""
    m, out = len(motif), []
    short = np.flatnonzero((piece.lengths >= SHORTEST) & (piece.lengths < m))
    number = piece.alphabet.number
    letters = sorted(set(motif))
    of = np.array([[x == y for y in letters] for x in motif], np.int16).cumsum(axis=0)
    of = np.concatenate([np.zeros((1, len(letters)), np.int16), of])
    for size in np.unique(piece.lengths[short]).tolist():
        own = short[piece.lengths[short] == size]
        low = piece.starts[own]
        zero = np.zeros(len(own), np.uint8)
        held = np.stack([piece.sums[number[x]][low + size] - piece.sums[number[x]][low] if number[x] in piece.sums else zero for x in letters], axis=1).astype(np.int16)
        cuts = np.array([(s, s + size) for s in range(m - size + 1)] + [(0, k) for k in range(1, size)] + [(m - k, m) for k in range(1, size)])
        shared = np.minimum(held[:, None, :], (of[cuts[:, 1]] - of[cuts[:, 0]])[None]).sum(axis=2)
        may = (200.0 * shared >= least * (size + cuts[:, 1] - cuts[:, 0])[None]).any(axis=1)
        for w in own[may].tolist():
            at = int(piece.starts[w] + piece.shift[w])
            score, place = partial_ratio(motif, texts[piece.rows[w]][at : at + size])
            if score >= least:
                out.append((w, int(piece.starts[w]) + place, score))
    return out


def fuzzy_places(texts: list[str | None], listed: list[str], least: float = FUZZY_LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, motif, position, score) of all windows of ``texts`` whose best partial ratio with a motif of ``listed`` (numbers from 0)
    reaches ``least``; once a row, motif and position, with the best score there. ``texts`` are in lower case."""
    alphabet = _Alphabet(listed)
    found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))]

    def read(parts: list[tuple[int, int, str, int]]) -> None:
        piece = _Piece(parts, alphabet)
        for i, motif in enumerate(listed):
            w, place, score = _aligned(piece, motif, least) if 0 < len(motif) <= SIZE else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if motif and (rest := _short_windows(piece, motif, least, texts)):
                more = [np.array(c) for c in zip(*rest, strict=True)]
                w, place, score = np.concatenate([w, more[0]]), np.concatenate([place, more[1]]), np.concatenate([score, more[2]])
            found.append((piece.rows[w], np.full(len(w), i), place + piece.shift[w], score))

    parts, held = [], 0
    whole = _PIECE // STEP * STEP
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), whole):
            parts.append((row, at, text[at : at + whole + SIZE - STEP], whole))
            held += len(parts[-1][2])
            if held >= _PIECE:
                read(parts)
                parts, held = [], 0
    if parts:
        read(parts)
    row, motif, position, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-score, position, motif, row))
    row, motif, position, score = row[order], motif[order], position[order], score[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(motif) != 0) | (np.diff(position) != 0)
    return row[new], motif[new], position[new], score[new]


def _fuzzy_listed(chosen: list[Rule] | None) -> list[tuple[str, str]]:
    return list(dict.fromkeys((r.category, r.expr.lower()) for r in (rules(["en"]) if chosen is None else chosen) if r.kind == "motif"))


def fuzzy_hits(text: Column, least: float = FUZZY_LEAST, chosen: list[Rule] | None = None) -> Column:
    """Array of (motif, category, position, length, score) of a text in lower case, as ``find_fuzzy`` has them; a row meets no other."""
    listed = _fuzzy_listed(chosen)
    motifs = [m for _, m in listed]
    if not listed:
        return F.array().cast(HITS)

    def match(texts: pa.Array) -> pa.Array:
        row, motif, position, score = fuzzy_places(texts.to_pylist(), motifs, least)
        offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        places = pa.StructArray.from_arrays([pa.array(motif, pa.int32()), pa.array(position, pa.int32()), pa.array(score, pa.float64())], names=["at", "position", "score"])
        return pa.ListArray.from_arrays(pa.array(offsets), places)

    match.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    found = F.arrow_udf(match, "array<struct<at:int,position:int,score:double>>")(text)
    names = F.array(*[F.struct(F.lit(m).alias("motif"), F.lit(c).alias("category"), F.lit(len(m)).alias("length")) for c, m in listed])
    of = lambda x: F.get(names, x["at"])
    return F.transform(found, lambda x: F.struct(of(x)["motif"].alias("motif"), of(x)["category"].alias("category"), x["position"].alias("position"), of(x)["length"].alias("length"), x["score"].alias("score")))


def find_fuzzy(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = FUZZY_LEAST, chosen: list[Rule] | None = None) -> DataFrame:
    """As ``find_exact``, with windows whose best partial ratio reaches ``least``.

    With L letters shared no alignment with k characters scores more than 200 * L / (motif's length + k); of the stretches of a text
    only those are aligned that share letters enough.
    """
    found = df.select(key, F.inline(fuzzy_hits(F.lower(F.col(text)), least, chosen)))
    return found.groupBy(key, "motif", "category", "position").agg(F.max("length").alias("length"), F.max("score").alias("score"))


def signal(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, density, total, nine features) of every row of ``df``; zeros without matches."""
    per = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), *[F.max(F.when(F.col("category") == c, F.col("score"))).alias(f"c_{c}") for c in MOTIFS])
    rows = df.select(key, F.length(text).alias("len")).join(per, key, "left")
    return rows.select(key, *_signal(F.col("len"), F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0.0)), {c: F.col(f"c_{c}") for c in MOTIFS}))


def signal_of(found: Column, length: Column) -> list[Column]:
    """The columns of ``signal`` from the array of ``exact_hits`` in its own row."""
    of = lambda c: F.when(F.exists(found, lambda x: x["category"] == c), F.lit(100.0))
    n = F.greatest(F.size(found), F.lit(0))
    return _signal(length, n, F.when(n > 0, F.lit(100.0)).otherwise(0.0), {c: of(c) for c in MOTIFS})


def _signal(length: Column, n: Column, top: Column, by: dict[str, Column]) -> list[Column]:
    """``by`` has the best score of each category, null without matches."""
    score = {c: F.coalesce(x, F.lit(0.0)) for c, x in by.items()}
    seen = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in by.values()), F.lit(0))
    density = F.when(length > 0, n * 1000.0 / length).otherwise(0.0)
    total = sum(score.values(), F.lit(0.0))
    features = [F.least(density / 10, F.lit(1.0)).alias("f_density"), *[(x / 100).alias(f"f_{c}") for c, x in score.items()], (top / 100).alias("f_top"), (seen / len(MOTIFS)).alias("f_categories")]
    return [density.alias("density"), total.alias("total"), *features]


def window_score(density: Column, n_categories: Column, mean_top: Column) -> Column:
    return F.least(density / 5, F.lit(1.0)) * 0.4 + F.least(n_categories / 3, F.lit(1.0)) * 0.3 + mean_top / 100 * 0.3
