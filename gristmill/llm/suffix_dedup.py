"""Exact removal of repeated byte strings by external induced suffix sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller key, or earlier in the
same document); strings never cross documents and are judged on the input.

Sharding. The value of a string is the least hash of its 16-byte grams, so equal strings have equal values. Runs
of consecutive string starts with one value are regions. A string holds ``HALF`` bytes before its least gram or ``HALF`` after it, so
a region that shares the gram with the bytes on neither side with another, and in which the gram occurs once, holds no
repeated string. All others go, with their bytes, to the shard of their value: equal strings always meet. Regions of
equal content travel once per block of documents.

Sorting. In a shard, the distinct regions are one text. The left-most S suffixes are sorted and induce all L and then all
S suffixes, bucket by bucket; what is induced into a bucket waits in a queue that spills to disk, in the order in which
it will leave, each suffix with the length of the prefix it shares with the one before it. Prefix lengths are
carried as range minima and saturate at ``LENGTH``; only that depth matters, so the samples are sorted to that
depth rather than by recursion. Neighbours that share ``LENGTH`` bytes are one string; its earliest place stays.

Defined results: null and empty texts have no bytes; documents shorter than ``LENGTH`` keep all; rows with the same
key are documents of their own, in the order of the input's blocks; the null key comes first; a text that is
removed in whole keeps the empty string; an empty table gives an empty result; only key and text are read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _pack, _unpack, small_batches
from .common import table, text_or_empty

LENGTH, GRAM = 100, 16
#: Of the bytes of a string beside its least gram, at least so many stand on one side of it.
HALF = (LENGTH - GRAM) // 2
BLOCK_BYTES, SLICE = 1 << 23, 1 << 20
#: Bytes that the queues of one sort keep in memory.
QUEUE_BYTES = 1 << 26
_NULL = np.iinfo(np.int64).min
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(0x2545F4914F6CDD1D)
_R_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))


# ---- suffix sorting of one shard -------------------------------------------------------------------------------


class SpillingQueues:
    """For each bucket a queue of (position, shared prefix); all go to a file once they exceed ``limit`` bytes."""

    def __init__(self, buckets: int, limit: int) -> None:
        self.held: list[list] = [[] for _ in range(buckets)]
        self.limit, self.size, self.file = limit, 0, None

    def push(self, bucket: int, position: np.ndarray, shared: np.ndarray) -> None:
        self.held[bucket].append((position, shared))
        self.size += position.nbytes + shared.nbytes
        if self.size > self.limit:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.held:
            for i, entry in enumerate(queue):
                if len(entry) == 2:
                    at = self.file.tell()
                    self.file.write(entry[0].tobytes())
                    self.file.write(entry[1].tobytes())
                    queue[i] = (at, len(entry[0]), entry[0].dtype)
        self.size = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for entry in self.held[bucket]:
            if len(entry) == 3:
                at, n, kind = entry
                self.file.seek(at)
                raw = self.file.read(n * (kind.itemsize + 1))
                entry = (np.frombuffer(raw, kind, n), np.frombuffer(raw, np.uint8, n, n * kind.itemsize))
            else:
                self.size -= entry[0].nbytes + entry[1].nbytes
            out.append(entry)
        self.held[bucket] = []
        if not out:
            return np.empty(0, np.int32), np.empty(0, np.uint8)
        return np.concatenate([p for p, _ in out]), np.concatenate([s for _, s in out])

    def close(self) -> None:
        if self.file:
            self.file.close()


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low:high + 1]`` for each pair; low <= high."""
    span = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out, level, k = np.empty(len(low), values.dtype), values, 0
    for k in range(int(span.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            level = np.minimum(level[:-half], level[half:])
        own = span == k
        if own.any():
            out[own] = np.minimum(level[low[own]], level[high[own] - (1 << k) + 1])
    return out


class _Scan:
    """Pushes the predecessors of suffixes that are scanned in order, with the prefix each shares with the last in its queue."""

    def __init__(self, queues: SpillingQueues, buckets: int) -> None:
        self.queues, self.low = queues, np.zeros(buckets, np.uint8)

    def batch(self, shared: np.ndarray, at: np.ndarray, before: np.ndarray, position: np.ndarray) -> None:
        """``shared`` is that of all scanned suffixes with the one scanned before; those at ``at`` push ``position`` to ``before``."""
        order = np.argsort(before, kind="stable")
        at, before, position = at[order], before[order], position[order]
        edges = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.empty(0, np.int64)
        if len(at):
            previous = np.concatenate([[0], at[:-1] + 1])
            previous[edges] = 0
            least = _range_minima(shared, previous, at)
            least[edges] = np.minimum(least[edges], self.low[before[edges]])
            carried = np.minimum(least, LENGTH - 1) + np.uint8(1)
        tail = np.minimum.accumulate(shared[::-1])[::-1] if len(shared) else shared
        self.low = np.minimum(self.low, tail[0]) if len(shared) else self.low
        for i, start in enumerate(edges.tolist()):
            stop = int(edges[i + 1]) if i + 1 < len(edges) else len(at)
            c, last = int(before[start]), int(at[stop - 1])
            self.queues.push(c, position[start:stop], carried[start:stop])
            self.low[c] = tail[last + 1] if last + 1 < len(tail) else LENGTH
        return


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and the length of the run of one character at its start."""
    n = len(text)
    ends = np.concatenate([np.flatnonzero(text[1:] != text[:-1]), [n - 1]])
    run = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[-1], ends])))
    following = np.concatenate([text[ends[:-1] + 1], [0]]).astype(np.int32)
    rises = following > text[ends]
    rises[-1] = True  # the end is the least suffix
    return rises[run], (ends[run] - np.arange(n) + 1).astype(np.int64)


def _words_at(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as a number of the same order; the text is padded by the caller."""
    return np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,))


def sort_samples(text: np.ndarray, samples: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``samples`` in the order of their suffixes to ``depth``, and the prefix each shares with the one before."""
    word = _words_at(np.concatenate([text, np.zeros(depth + 16, np.uint8)]))
    order, group = samples.copy(), np.zeros(len(samples), np.int64)
    active = np.arange(len(samples))
    for at in range(0, depth, 8):
        if not len(active):
            break
        key = word[order[active] + at].astype(np.uint64)
        by = np.lexsort((key, group[active]))
        order[active], key, own = order[active][by], key[by], group[active][by]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        starts = np.flatnonzero(new)
        group[active] = active[starts[np.cumsum(new) - 1]]
        sizes = np.diff(np.concatenate([starts, [len(active)]]))
        active = active[np.repeat(sizes > 1, sizes)]
    shared, left = np.zeros(len(order), np.uint8), np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = word[order[left] + at] ^ word[order[left - 1] + at]
        same = differ == 0
        part = left[~same]
        shared[part] = at + (63 - (np.frexp(differ[~same].astype(np.float64))[1] - 1).clip(0, 63)) // 8
        shared[left[same]] = at + 8
        left = left[same]
    return order, np.minimum(shared, depth).astype(np.uint8)


def sorted_suffixes(text: np.ndarray, queue_bytes: int = QUEUE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` (bytes; 0 only at its end) in descending order, in batches: positions and the prefix
    each shares with the one *after* it in ascending order's sense, that is with the suffix given before it."""
    n = len(text)
    is_s, run = _types(text)
    samples = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    samples = samples.astype(np.int32 if n < 1 << 31 else np.int64)
    order, shared = sort_samples(text, samples) if len(samples) else (samples, np.empty(0, np.uint8))
    first = text[order]
    edges = np.searchsorted(first, np.arange(257))
    forward, stored = SpillingQueues(256, queue_bytes), SpillingQueues(256, queue_bytes)
    scan = _Scan(forward, 256)

    def step(c: int, positions: np.ndarray, own: np.ndarray, scan: _Scan, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scan one batch of bucket ``c``; what it induces into ``c`` itself is returned."""
        at = np.flatnonzero(positions > 0)
        before = positions[at] - 1
        keep = is_s[before] == wanted
        at, before = at[keep], before[keep]
        char = text[before]
        inside = char == c
        nothing = np.empty(0, np.uint8)
        if inside.any():
            here = at[inside]
            nothing = np.minimum(_range_minima(own, np.concatenate([[0], here[:-1] + 1]), here), LENGTH - 1) + np.uint8(1)
        scan.batch(own, at[~inside], char[~inside], before[~inside])
        return before[inside], nothing

    for c in range(256):
        positions, own = forward.pop(c)
        generation = 0
        if len(own):
            own = own.copy()
            own[0] = 0
        while len(positions):
            generation += 1
            stored.push(c, positions, own)
            last = int(run[positions[-1]])
            positions, own = step(c, positions, own, scan, False)
            if len(own):
                own = own.copy()
                own[0] = min(generation, LENGTH)
        some = slice(edges[c], edges[c + 1])
        if edges[c] < edges[c + 1]:
            own = shared[some].copy()
            own[0] = min(last, int(run[order[some.start]]), LENGTH) if generation else 0
            step(c, order[some], own, scan, False)
        elif c == 0 and n > 1 and not is_s[n - 2]:  # the end itself, where it is no sample
            step(0, np.array([n - 1], samples.dtype), np.zeros(1, np.uint8), scan, False)
    forward.close()

    backward = SpillingQueues(256, queue_bytes)
    scan = _Scan(backward, 256)
    for c in range(255, 0, -1):
        positions, own = backward.pop(c)
        generation, last = 0, 0
        if len(own):
            own = own.copy()
            own[0] = 0
        while len(positions):
            generation += 1
            yield positions, own
            last = int(run[positions[-1]])
            positions, own = step(c, positions, own, scan, True)
            if len(own):
                own = own.copy()
                own[0] = min(generation, LENGTH)
        positions, own = stored.pop(c)
        if len(positions):
            positions = positions[::-1]
            own = np.concatenate([[min(last, int(run[positions[0]]), LENGTH) if generation else 0], own[:0:-1]]).astype(np.uint8)
            yield positions, own
            step(c, positions, own, scan, True)
    backward.close()
    stored.close()


# ---- regions of a block ----------------------------------------------------------------------------------------


def _first_equal(h: np.ndarray, picks: np.ndarray, first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each region the first of ``picks`` from ``first`` on whose gram has the region's value."""
    at = np.searchsorted(picks, first)
    left = np.flatnonzero(h[picks[at]] != value) if len(at) else at
    while len(left):
        at[left] += 1
        left = left[h[picks[at[left]]] != value[left]]
    return picks[at]


class Regions:
    """Of the concatenated texts of a block: first start, number of starts, value and content hash of each region.

    ``sides``: hashes of the least grams with the bytes on one side, where strings of the region hold them; ``owner`` is the region.
    Regions in which the gram occurs again are periodic: their hashes, each once, have no owner (-1).
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        n = len(data)
        begins = np.concatenate([[0], ends[:-1]])
        whole = np.ndarray((max(n - 7, 0),), "<u8", data.tobytes() if n else b"", strides=(1,)) if n >= 8 else np.empty(0, np.uint64)
        out, sides, owners, others, before = [], [], [], [], 0
        for at in range(0, max(n - LENGTH + 1, 0), SLICE):
            stop = min(at + SLICE, n - LENGTH + 1)  # string starts of this slice
            m = stop - at + LENGTH - GRAM
            h = (whole[at : at + m] * _M1) ^ (whole[at + 8 : at + 8 + m] * _M2)
            h ^= h >> np.uint64(29)
            h *= _M3
            h ^= h >> np.uint64(32)
            least = h
            for k in (1, 2, 4, 8, 16, 32):
                least = np.minimum(least[:-k], least[k:])
            rest = LENGTH - GRAM + 1 - 64
            least = np.minimum(least[: stop - at], least[rest : rest + stop - at])
            # a gram that is the least of a string, and again within the same run: the region may repeat itself
            most = np.concatenate([np.zeros(rest + 63, np.uint64), least, np.zeros(rest + 63, np.uint64)])
            for k in (1, 2, 4, 8, 16, 32):
                most = np.maximum(most[:-k], most[k:])
            picks = np.flatnonzero(np.maximum(most[:m], most[rest : rest + m]) == h)
            again = (h[picks[1:]] == h[picks[:-1]]) & (picks[1:] - picks[:-1] <= rest + 64)
            twice = np.unique(h[picks[1:][again]])
            starts = np.arange(at, stop)
            doc = np.searchsorted(ends, starts, side="right")
            inside = starts + LENGTH <= ends[doc]
            new = inside.copy()
            new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            stops = np.concatenate([first[1:], [len(starts)]])
            counts = np.add.reduceat(inside, first, dtype=np.int64)
            assert (counts <= stops - first).all()
            power = np.full(m, _R, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * power)])
            back = np.full(m, _R_INVERSE, np.uint64)
            back[0] = 1
            back = np.multiply.accumulate(back)
            content = (sums[first + counts + LENGTH - GRAM] - sums[first]) * back[first]
            periodic = np.isin(least[first], twice)
            out.append((first + at, counts, least[first], content, doc[first], periodic))

            def hashed(begin: np.ndarray, sums: np.ndarray = sums, back: np.ndarray = back) -> np.ndarray:
                return (sums[begin + HALF + 1] - sums[begin]) * back[begin]

            alone = np.flatnonzero(~periodic)
            place = _first_equal(h, picks, first[alone], least[first[alone]])
            for some, shift, mark in ((first[alone] <= place - HALF, HALF, _M2), (first[alone] + counts[alone] - 1 > place - HALF, 0, _M3)):
                sides.append(hashed(place[some] - shift) ^ mark)
                owners.append(alone[some] + before)
            again = picks[np.isin(h[picks], twice)]
            others += [hashed(again[again >= HALF] - HALF) ^ _M2, hashed(again[again + HALF < m]) ^ _M3]
            before += len(first)
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64, bool)
        self.start, self.count, self.value, self.content, self.doc, self.periodic = (np.concatenate([np.empty(0, k), *(o[i] for o in out)]) for i, k in enumerate(kinds))
        apart = np.unique(np.concatenate([np.empty(0, np.uint64), *others]))
        self.sides = np.concatenate([*sides, apart])
        self.owner = np.concatenate([np.empty(0, np.int64), *owners, np.full(len(apart), -1)])
        self.begins = begins


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    parts = []
    for i in range(0, len(start), 1 << 14):
        s, n = start[i : i + (1 << 14)], length[i : i + (1 << 14)]
        ends = np.cumsum(n)
        parts.append(data[np.arange(ends[-1]) + np.repeat(s - (ends - n), n)])
    return np.concatenate([np.empty(0, np.uint8), *parts])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(block, keys, concatenated bytes, ends of documents)."""
    task, k, keys, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

    def block() -> tuple[int, list, np.ndarray, np.ndarray]:
        return task << 32 | k, keys, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])

    for batch in batches:
        for key, raw in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            keys.append(key)
            texts.append(raw)
            held += len(raw)
            if held >= BLOCK_BYTES:
                yield block()
                k, keys, texts, held = k + 1, [], [], 0
    if keys:
        yield block()


def _spread(value: np.ndarray, n: int) -> np.ndarray:
    return ((value * _M1) >> np.uint64(40)) % np.uint64(n)


# ---- one shard -------------------------------------------------------------------------------------------------


def _shard(rows: pa.Table, queue_bytes: int) -> pa.Table:
    """Starts to remove, as ranges, by block."""
    lists = {c: rows.column(c).to_pylist() for c in ("value", "content", "counts", "data", "which", "keys", "docs", "starts")}
    blocks = rows.column("block").to_pylist()
    contents = [np.rec.fromarrays([_unpack(v, np.uint64), _unpack(c, np.uint64), _unpack(n, np.int64)], names="v,c,n") for v, c, n in zip(lists["value"], lists["content"], lists["counts"], strict=True)]
    sizes = [len(c) for c in contents]
    every = np.concatenate(contents)
    _, first, number = np.unique(every, return_index=True, return_inverse=True)
    lengths = every["n"][first] + LENGTH - 1
    # the text: distinct contents, each ended by the byte 255, which UTF-8 never holds; 254 stands in for NUL
    offset = np.concatenate([[0], np.cumsum(every["n"] + LENGTH - 1)])
    data = np.concatenate([_unpack(d, np.uint8) for d in lists["data"]])
    if not len(offset) - 1 == len(every) or offset[-1] != len(data):
        raise RuntimeError("regions and bytes disagree")
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.zeros(place[-1] + 1, np.uint8)
    own = np.ones(place[-1], bool)
    own[place[1:] - 1] = False
    text[:-1][own] = _gather(data, offset[first], lengths)
    text[:-1][~own] = 255
    text[:-1][text[:-1] == 0] = 254
    del data, own
    # occurrences, and the first of each content
    base = np.concatenate([[0], np.cumsum(sizes)])
    which = number[np.concatenate([base[i] + _unpack(w, np.int32) for i, w in enumerate(lists["which"])])]
    key, doc, start = (np.concatenate([_unpack(x, np.int64) for x in lists[c]]) for c in ("keys", "docs", "starts"))
    row = np.repeat(np.arange(len(blocks)), [len(_unpack(w, np.int32)) for w in lists["which"]])
    block = np.array(blocks, np.int64)[row]
    by = np.lexsort((start, doc, block, key))
    rank = np.empty(len(by), np.int64)
    # places in the order of (key, block, document, start); documents are numbered so that starts can be added
    changed = np.concatenate([[0], np.cumsum((key[by][1:] != key[by][:-1]) | (block[by][1:] != block[by][:-1]) | (doc[by][1:] != doc[by][:-1]))])
    rank[by] = changed << 40
    rank += start
    earliest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(earliest, which, rank)
    copies = np.bincount(which, minlength=len(first))
    # strings that occur twice: for all occurrences but the first of a content, and for the first
    later, leading = np.zeros(len(text), bool), np.zeros(len(text), bool)
    held: list[np.ndarray] = []

    def close(positions: np.ndarray, shared: np.ndarray) -> None:
        region = np.searchsorted(place, positions, side="right") - 1
        within = positions - place[region]
        valid = (region < len(first)) & (within < every["n"][first][np.minimum(region, len(first) - 1)])
        group = np.cumsum(shared < LENGTH)
        positions, region, within, group = positions[valid], region[valid], within[valid], group[valid]
        if not len(positions):
            return
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        at = earliest[region] + within
        least = np.minimum.reduceat(at, edges)
        total = np.add.reduceat(copies[region], edges)
        n = np.diff(np.concatenate([edges, [len(at)]]))
        later[positions] = np.repeat(total > 1, n)
        leading[positions] = at > np.repeat(least, n)

    for positions, shared in sorted_suffixes(text, queue_bytes):
        cut = np.flatnonzero(shared < LENGTH)
        if held and len(cut):
            held += [(positions[: cut[0]], shared[: cut[0]])]
            close(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        if len(cut):
            last = cut[-1]
            close(positions[cut[0] : last], shared[cut[0] : last])
            held = [(positions[last:], shared[last:])]
        else:
            held.append((positions, shared))
    if held:
        close(*(np.concatenate(x) for x in zip(*held, strict=True)))

    # ranges of starts by content, then by occurrence
    def ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        low, high = edge[::2], edge[1::2]
        region = np.searchsorted(place, low, side="right") - 1
        return region, low - place[region], high - place[region]

    is_first = rank == earliest[which]
    out = []
    for mask, some in ((later, ~is_first), (leading, is_first)):
        region, low, high = ranges(mask)
        begin, end = np.searchsorted(region, which[some]), np.searchsorted(region, which[some], side="right")
        n = end - begin
        ends = np.cumsum(n)
        pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)
        rep = np.repeat(np.flatnonzero(some), n)
        out.append((row[rep], doc[rep], start[rep] + low[pick], start[rep] + high[pick]))
    r, d, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(r, kind="stable")
    edges = np.searchsorted(r[by], np.arange(len(blocks) + 1))
    packed = [_pack(d[by[a:b]], low[by[a:b]], high[by[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table([pa.array(blocks, pa.int64()), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(3))], ["block", "docs", "low", "high"])


# ---- the operator ----------------------------------------------------------------------------------------------


def marked(docs: DataFrame, key: str = "doc_id", queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """(key, text as bytes, low array<long>, high array<long>): the maximal runs of bytes to remove, of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets, n_shards = partitions, 4 * partitions
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty().cast("binary").alias("raw"))

    def values_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, data, ends in _block_rows(batches):
            value = Regions(data, ends).sides
            bucket = _spread(value, n_buckets)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            own = [value[by[edges[i] : edges[i + 1]]].tobytes() for i in some.tolist()]
            yield pa.record_batch([pa.array(np.full(len(some), block), pa.int64()), pa.array(some, pa.int32()), pa.array(own, pa.binary())], ["block", "bucket", "value"])

    def repeated(rows: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in rows.column("value").to_pylist()]
        _, number, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice, at, out = count[number] > 1, 0, []
        for x in lists:
            out.append(np.packbits(twice[at : at + len(x)]).tobytes())
            at += len(x)
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "twice"])

    def texts_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, data, ends in _block_rows(batches):
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array(_pack(ends.astype(np.int64)), pa.binary()), pa.array(_pack(data), pa.binary())], ["block", "keys", "ends", "data"])

    def regions_out(texts: pa.Table, flags: pa.Table) -> pa.Table:
        data, ends = _unpack(texts.column("data")[0].as_py(), np.uint8), _unpack(texts.column("ends")[0].as_py(), np.int64)
        r = Regions(data, ends)
        bucket = _spread(r.sides, n_buckets)
        by = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket.astype(np.int64), minlength=n_buckets)
        bits = {b: x for b, x in zip(flags.column("bucket").to_pylist(), flags.column("twice").to_pylist(), strict=True)}
        twice = np.zeros(len(by), bool)
        twice[by] = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(n)).astype(bool) for b, n in enumerate(counts) if n)])
        keys = np.array([_NULL if k is None else k for k in texts.column("keys")[0].as_py()], np.int64)
        wanted = r.periodic.copy()
        wanted[r.owner[twice & (r.owner >= 0)]] = True
        some = np.flatnonzero(wanted)
        shard = _spread(r.value[some] ^ _M2, n_shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        some, edges = some[order], np.searchsorted(shard[order], np.arange(n_shards + 1))
        out: dict[str, list] = {c: [] for c in ("shard", "value", "content", "counts", "data", "which", "keys", "docs", "starts")}
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own = some[edges[s] : edges[s + 1]]
            same = np.rec.fromarrays([r.value[own], r.content[own], r.count[own]], names="v,c,n")
            distinct, first, which = np.unique(same, return_index=True, return_inverse=True)
            raw = _gather(data, r.start[own[first]], distinct["n"] + LENGTH - 1)
            out["shard"].append(s)
            doc = r.doc[own]
            packed = _pack(distinct["v"].copy(), distinct["c"].copy(), distinct["n"].copy(), raw, which.astype(np.int32), keys[doc], doc, r.start[own] - r.begins[doc])
            for c, x in zip(list(out)[1:], packed, strict=True):
                out[c].append(x)
        n = len(out["shard"])
        return pa.table([pa.array(out["shard"], pa.int32()), pa.array([texts.column("block")[0].as_py()] * n, pa.int64()), *(pa.array(out[c], pa.binary()) for c in list(out)[1:])], ["shard", "block", *list(out)[1:]])

    def ranges_in(texts: pa.Table, found: pa.Table) -> pa.Table:
        data, ends = _unpack(texts.column("data")[0].as_py(), np.uint8), _unpack(texts.column("ends")[0].as_py(), np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        doc, low, high = (np.concatenate([np.empty(0, np.int64), *(_unpack(x, np.int64) for x in found.column(c).to_pylist())]) for c in ("docs", "low", "high"))
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, begins[doc] + low, 1)
        np.add.at(cover, begins[doc] + high + LENGTH - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
        edge = np.unique(np.concatenate([edge, [0], ends])) if len(data) else np.zeros(1, np.int64)
        runs = edge[:-1][gone[edge[:-1]]] if len(data) else np.empty(0, np.int64)
        stops = edge[1:][gone[edge[:-1]]] if len(data) else np.empty(0, np.int64)
        cuts = np.searchsorted(runs, np.concatenate([begins, ends[-1:]]))
        owner = np.repeat(np.arange(len(ends)), np.diff(cuts))
        lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x - begins[owner])) for x in (runs, stops)]
        raw = data.tobytes()
        own = pa.array([raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())
        return pa.table([texts.column("keys").combine_chunks().flatten(), own, *lists], ["key", "raw", "low", "high"])

    values = rows.mapInArrow(values_out, "block long, bucket int, value binary")
    flags = values.groupBy("bucket").applyInArrow(repeated, "block long, bucket int, twice binary")
    texts = rows.mapInArrow(texts_out, "block long, keys array<long>, ends binary, data binary")
    binaries = ", ".join(f"{c} binary" for c in ("value", "content", "counts", "data", "which", "keys", "docs", "starts"))
    regions = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(regions_out, f"shard int, block long, {binaries}")
    found = regions.groupBy("shard").applyInArrow(lambda t: _shard(t, queue_bytes), "block long, docs binary, low binary, high binary")
    again = texts.toDF(*texts.columns)
    out = again.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(ranges_in, "key long, raw binary, low array<long>, high array<long>")
    return out.withColumnRenamed("key", key)


def deduplicated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = marked(docs, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for raw, low, high in zip(*(batch.column(c).to_pylist() for c in ("raw", "low", "high")), strict=True):
                at, parts = 0, []
                for a, b in zip(low, high, strict=True):
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
            raw_sizes = [len(x) for x in batch.column("raw").to_pylist()]
            out = [batch.column(key), pa.array(kept, pa.binary()), pa.array(raw_sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(raw_sizes, kept, strict=True)], pa.int64())]
            out += [pa.array([len(x) for x in batch.column("low").to_pylist()], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.record_batch(out, [key, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(cut, f"`{key}` long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
