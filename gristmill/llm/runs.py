"""Periodic runs of words: texts that go round in circles, found over Lyndon arrays (after Ellert and Fischer).

A run is a longest stretch of consecutive words with smallest period q (words q apart are equal). Every run of two
periods or more holds, in one of the two orders of its words, a longest Lyndon word that begins within its
first period; so a pass over the Lyndon array of each order finds all of them. ``next_smaller`` computes that array
together with how far each suffix agrees with its next smaller one. Words are compared beyond the farthest place
that any comparison has reached; before it, results are taken over from the stretch that matched. Neither suffix
arrays or trees nor hashes of stretches are used, and the words compared grow with the length of the text alone.

Spark deals the documents; in a task Arrow splits and numbers the words. A word that its document holds only once is in no run
and ends the stretch before it; every stretch of at least 12 words goes through both Lyndon arrays.

Defined results: null and empty texts have no words and no runs, both digests are those of the empty text; a null id
changes no words; repeated rows each get their row; ties of the longest run go to the smallest start, then the smallest
period; an empty table gives an empty result; only the id and the text are read. A task holds an Arrow batch of at most
1,000 documents and 16 MB, or one longer document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import split_words, table

LEAST = 12


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix of ``s`` the start of the next smaller one (``len(s)`` if none), and how many words both share.

    The difference of the two starts is the length of the longest Lyndon word there. The suffixes before i that are smaller
    than all between form a chain; i meets them from the last one on. Where a suffix k of the chain shares ``common[k]`` words
    with the one before it in the chain, and i shares another number with k, the outcome of the next meeting is
    known. If both are equal, words are compared from there on. ``[begin, far)`` is the stretch that reached farthest
    and equals what stands ``shift`` before it, so meetings inside it have been held before.
    """
    n = len(s)
    after, reach, before, common = [n] * n, [0] * n, [-1] * n, [0] * n
    begin = far = shift = 0
    for i in range(1, n):
        k, same, open_ = i - 1, 0, True
        while k >= 0:
            if open_:
                if i + same < far and k >= begin:
                    a, b = k - shift, i - shift
                    known = reach[a] if after[a] == b else common[b] if before[b] == a else same
                    same = min(known, far - i) if known > same else same
                    settled = i + known < far and (after[a] == b or before[b] == a)
                else:
                    settled = False
                if not settled:
                    while i + same < n and s[k + same] == s[i + same]:
                        same += 1
                    if i + same > far:
                        begin, far, shift = i, i + same, i - k
                if i + same < n and s[k + same] < s[i + same]:
                    break
            after[k], reach[k] = i, same
            shared, k = common[k], before[k]
            if k >= 0 and shared < same:
                same = shared
                break
            open_ = shared == same
        before[i] = k
        common[i] = same if k >= 0 else 0
    return after, reach


def _runs_of_order(s: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs whose Lyndon words are those of the order of ``s``."""
    after, reach = next_smaller(s)
    n = len(s)
    left: list[int | None] = [None] * n
    end = low = n  # [low, end) equals what stands ``shift`` behind it
    shift = 0
    for j in range(n - 1, -1, -1):
        b, right = after[j], reach[j]
        if not right:  # the run's first such word begins within its first period, so the rest must follow
            continue
        p, back, settled = b - j, 0, False
        if low < j and b <= end and after[j + shift] == b + shift and (known := left[j + shift]) is not None:
            back = min(known, j - low)
            settled = j - known > low or known == p
        if not settled:
            while back < p and back < j and s[j - 1 - back] == s[b - 1 - back]:
                back += 1
            if j - back < low:
                low, end, shift = j - back, j, p
        left[j] = back
        if back < p <= back + right and back + p + right >= least:
            yield j - back, back + p + right, p


def runs(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words or more, by start and period."""
    return sorted({*_runs_of_order(s, least), *_runs_of_order([-x for x in s], least)})


def _stretches(code: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of ``least`` words or more of one document between words that it holds only once, which are in no run."""
    if len(code) < least:
        return []
    _, number, n = np.unique(doc * (int(code.max()) + 1) + code, return_inverse=True, return_counts=True)
    held = np.concatenate([[False], n[number] > 1, [False]])
    edge = np.flatnonzero(held[1:] != held[:-1])
    cuts = np.flatnonzero(np.diff(doc)) + 1
    cuts = cuts[held[cuts] & held[cuts + 1]]  # stretches of neighbouring documents may touch
    both = np.sort(np.concatenate([edge, cuts, cuts]))
    return [(a, b) for a, b in zip(both[::2].tolist(), both[1::2].tolist(), strict=True) if b - a >= least]


def _source(doc_id: int | None, n: int) -> np.ndarray:
    """Which of the ``n`` words stands at each place: the rows chosen by their id go round from some word on."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def batch_runs(texts: pa.Array, ids: list[int | None], least: int = LEAST, source=_source) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:  # noqa: ANN001
    """The runs of each text, and the texts without what repeats: words kept, joined by one blank."""
    sizes, flat = split_words(texts)
    flat = flat.cast(pa.large_string())  # texts that go round may grow
    begins = np.concatenate([[0], np.cumsum(sizes)])
    if source:
        flat = flat.take(pa.array(np.concatenate([np.empty(0, np.int64), *(b + source(k, n) for k, b, n in zip(ids, begins.tolist(), sizes.tolist(), strict=False))])))
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    drop = np.zeros(len(code) + 1, np.int64)
    for a, b in _stretches(code, doc, least):
        d = int(doc[a])
        for start, length, period in runs(code[a:b].tolist(), least):
            found[d].append((a + start - int(begins[d]), length, period))
            drop[a + start + period] += 1
            drop[a + start + length] -= 1
    kept = np.cumsum(drop)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[begins]
    words = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat.filter(pa.array(kept)))
    return found, pc.binary_join(words, pa.scalar(" ", pa.large_string()))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    for batch in batches:
        found, collapsed = batch_runs(batch.column("text"), batch.column("doc_id").to_pylist())
        rows = []
        for own in found:
            top = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            listed = "".join(f"{a},{n},{p}\n" for a, n, p in sorted(own))
            rows.append((len(own), *(top or (None, None, None)), top and 1000 * top[1] // top[2], _sha(listed)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.string()]
        shas = pa.array([_sha(x) for x in collapsed.to_pylist()], pa.string())
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), shas], names)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        found, collapsed = batch_runs(batch.column("text"), [None] * len(batch), source=None)
        listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in sorted(own)] for own in found]
        yield pa.record_batch([batch.column("key"), pa.array(listed, kind), collapsed.cast(pa.string())], ["key", "runs", "collapsed"])


def run_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs array<struct<start, length, period>>, collapsed) of each text as it stands."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_collapse, "key long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("key", key)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digests, _SCHEMA)
