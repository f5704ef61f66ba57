"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word windows (as 64-bit hashes); one to four words make one window. Documents
with equal sets are one class, named by the digest of its set; ids are labels only. Classes that agree in a band of their
MinHash signature are candidates. Connected candidates form a group, whose rows meet once; groups of more
than ``GIANT`` classes, chained by what many texts share, are left to their bands instead, and a pair is compared in the first band
that it shares. In a task pairs are compared by MinHash values in steps: a pair is dropped as soon as the
posterior probability (uniform prior) that its similarity reaches the threshold falls below a tolerance; what is left is
verified on the sets. Groups are cut into chunks of bounded rows and weight and each pair of chunks is a task of its
own; tasks give one row per class, never one per pair.

With 40 bands of 6 values a pair of similarity 0.8 misses all bands with probability 5e-6; the pruning drops a
pair that reaches the threshold with at most the stated tolerance per step.

Defined results: null and empty texts, and texts without words, have no windows, no links and a class of their
own; repeated rows are documents of one class; rows of one id with different texts are documents of their own; the class
id is the smallest key of the connected group, null only if all its keys are; an empty table gives an empty
result; only key and text are read, other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import small_batches
from .common import lean, split_words, stored, table, unused

GRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
STEP, TOLERANCE = 16, 1e-6
#: Windows in a chunk; rows in a chunk are an eighth of the group, within bounds. A task holds two chunks.
CHUNK_WEIGHT = 1 << 20
CHUNK_ROWS = (512, 8192)
#: Classes in a connected group from which on candidates meet by band.
GIANT = 1 << 15
_RNG = np.random.Generator(np.random.PCG64(10))
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_sets(texts: pa.Array, gram: int = GRAM) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct windows."""
    sizes, flat_words = split_words(texts)
    coded = flat_words.dictionary_encode()
    by_word = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    flat = by_word[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    whole = np.zeros(max(len(flat) - gram + 1, 0), np.uint64)
    for j in range(gram):
        whole = _mixed(whole * _MIX + flat[j : j + len(whole)])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= gram:
            out.append(np.unique(whole[at : at + n - gram + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for j in range(n):
                h = _mixed(h * _MIX + flat[at + j])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def signature(windows: np.ndarray) -> np.ndarray:
    x = (windows >> np.uint64(32)).astype(np.uint32) ^ windows.astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(sign: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        h = _mixed(h * _MIX + sign.reshape(BANDS, ROWS)[:, r])
    return h.view(np.int64)


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The fewest of ``n`` equal MinHash values at which the posterior still allows the threshold.

    With a uniform prior the chance of a similarity of ``threshold`` or more is P[Binomial(n + 1, threshold) <= m].
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _digest(windows: np.ndarray) -> bytes | None:
    return hashlib.blake2b(windows.tobytes(), digest_size=16).digest() if len(windows) else None


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = window_sets(batch.column("text"))
        bands = [band_keys(signature(s)) if len(s) else None for s in sets]
        own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.record_batch([batch.column("key"), batch.column("hash"), *own], ["key", "hash", "n_windows", "same", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = window_sets(batch.column("text"))
        yield pa.record_batch([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], ["same", "windows", "sign"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b with b < a): the smallest node it is connected with.

    First each node keeps one edge, to the least of its neighbours below; its others become edges between these
    neighbours, of which a group has few. Each round then takes the least root among neighbours and jumps to the root's
    root, so rounds grow with the logarithm of the longest path; each round is written to the shared folder.
    """
    below = stored(edges.groupBy("a").agg(F.min("b").alias("home"), F.collect_set("b").alias("others")), f"{name}-below")  # as many others as the node has bands or tasks
    between = below.select(F.explode("others").alias("a"), "home").filter("a <> home").distinct()
    kept = stored(below.select("a", "home").unionByName(between), f"{name}-edges")
    both = kept.select("a", F.col("home").alias("b")).unionByName(kept.select(F.col("home").alias("a"), F.col("a").alias("b")))
    roots = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), f"{name}-roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("low"))
        step = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        over = roots.select(F.col("node").alias("at"), F.col("root").alias("up"))
        step = stored(step.join(over, step["root"] == over["at"]).select("node", "old", F.least("root", "up").alias("root")), f"{name}-roots")
        roots = step.select("node", "root")
        if step.filter("root <> old").isEmpty():
            return roots


def _links(threshold: float, tolerance: float):  # noqa: ANN202
    """The task of one pair of chunks: per class its links into the other chunk and the least class it is connected with."""
    needed = [least_matches(threshold, tolerance, n) for n in range(STEP, BANDS * ROWS + 1, STEP)]

    def pairs(sign: np.ndarray, size: np.ndarray, low: int, high: int, first: int, stop: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Candidates i in [low, high), j in [first, stop) left by sizes and posterior."""
        a, b = size[low:high, None], size[None, first:stop]
        fits = np.minimum(a, b) >= threshold * np.maximum(a, b)
        if same:
            fits &= np.arange(low, high)[:, None] < np.arange(first, stop)[None, :]
        count = np.zeros(fits.shape, np.uint8)
        for k in range(STEP):
            count += sign[low:high, k, None] == sign[None, first:stop, k]
        i, j = np.nonzero(fits & (count >= needed[0]))
        n = count[i, j].astype(np.int16)
        i, j = i + low, j + first
        for step, least in enumerate(needed[1:], 1):
            if not len(i):
                break
            for c in range(0, len(i), 1 << 18):
                own = slice(c, c + (1 << 18))
                n[own] += (sign[i[own], step * STEP : (step + 1) * STEP] == sign[j[own], step * STEP : (step + 1) * STEP]).sum(axis=1, dtype=np.int16)
            left = n >= least
            i, j, n = i[left], j[left], n[left]
        return i, j

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        band, low_chunk, high_chunk = (k.as_py() for k in key[1:])
        rows = rows.take(pc.sort_indices(rows, [("chunk", "ascending"), ("same", "ascending")]))
        chunk, copies = (rows.column(c).to_numpy() for c in ("chunk", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("windows").to_pylist()]
        sign = np.stack([np.frombuffer(x, np.uint32) for x in rows.column("sign").to_pylist()])
        bands = None if band is None else np.stack([band_keys(x) for x in sign])
        size = np.array([len(s) for s in sets], np.int64)
        _, columns = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(int(columns.max()) + 1, bool)
        n, same = len(sets), low_chunk == high_chunk
        half = n if same else int(np.searchsorted(chunk, high_chunk))
        links, root = np.zeros(n, np.int64), np.arange(n)
        firsts: list[np.ndarray] = []
        seconds: list[np.ndarray] = []

        def in_first_band(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether this task's band is the first that the pair shares."""
            out = np.empty(len(i), bool)
            for c in range(0, len(i), 1 << 16):
                at = slice(c, c + (1 << 16))
                first = (bands[i[at]] == bands[j[at]]).argmax(axis=1)
                out[at] = bands[i[at], first] == band
            return out

        def settle() -> None:
            """Lower every root to the least among linked documents."""
            i, j = np.concatenate(firsts), np.concatenate(seconds)
            firsts.clear(), seconds.clear()
            while True:
                least = np.minimum(root[i], root[j])
                before = root.copy()
                for at in (root[i], root[j], i, j):
                    np.minimum.at(root, at, least)
                root[:] = root[root]
                if (root == before).all():
                    return

        step = max(1, min(256, (1 << 22) // max(n, 1)))
        for low in range(0, half, step):
            high = min(low + step, half)
            i, j = pairs(sign, size, low, high, low if same else half, n, same)
            if band is not None:
                mine = in_first_band(i, j)
                i, j = i[mine], j[mine]
            for x in np.unique(i).tolist():
                others = j[i == x] if high - low > 1 else j
                seen[columns[starts[x] : starts[x + 1]]] = True
                for c in range(0, len(others), 4096):
                    own = others[c : c + 4096]
                    ends = np.cumsum(size[own])
                    place = np.arange(ends[-1]) + np.repeat(starts[own] - (ends - size[own]), size[own])
                    shared = np.add.reduceat(seen[columns[place]], ends - size[own], dtype=np.int64)
                    linked = own[shared >= threshold * (size[x] + size[own] - shared) - 1e-9]
                    if len(linked):
                        links[x] += copies[linked].sum()
                        links[linked] += copies[x]
                        firsts.append(np.full(len(linked), x))
                        seconds.append(linked)
                seen[columns[starts[x] : starts[x + 1]]] = False
            if sum(map(len, firsts)) > 1 << 20:
                settle()
        if firsts:
            settle()
        ids = rows.column("same").combine_chunks()
        return pa.table([ids, pa.array(links, pa.int64()), ids.take(pa.array(root, pa.int64()))], ["same", "links", "root"])

    return task


def _rows(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("hash"), "text")


def grouped(docs: DataFrame, key: str, threshold: float, tolerance: float, chunk_weight: int, giant: int) -> tuple[DataFrame, DataFrame]:
    """(key, hash, same) of every row, and of every class (same, rep, group, class_id, n_links): its own first row, the
    least class it is connected with, the least key of that group, and how many other rows each of its rows is similar to."""
    sketched = stored(_rows(docs, key).mapInArrow(lean(_sketches), "key long, hash long, n_windows long, same binary, bands array<long>"), "sketches")
    rep = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    classes = stored(sketched.filter("same is not null").groupBy("same").agg(F.min(rep).alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")

    shown = classes.select(F.col("same").alias("c_same"), "rep", "copies")
    chosen = sketched.join(shown, (sketched["same"] == shown["c_same"]) & sketched["key"].eqNullSafe(shown["rep"]["key"]) & (sketched["hash"] == shown["rep"]["hash"]))
    firsts = stored(chosen.select("same", "rep", "n_windows", "copies", "bands").dropDuplicates(["same"]), "firsts")
    banded = firsts.select("same", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("same").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = stored(banded.join(buckets, "band"), "hits")
    groups = components(hits.filter("same <> least").select(F.col("same").alias("a"), F.col("least").alias("b")), "candidates")

    members = firsts.join(groups, firsts["same"] == groups["node"])
    members = stored(members.select("same", F.col("rep.key").alias("w_key"), F.col("rep.hash").alias("w_hash"), F.col("root").alias("cluster"), "copies", "n_windows"), "members")
    total = [F.count(F.lit(1)).alias("n"), F.sum("n_windows").alias("weight")]
    sizes = stored(members.groupBy("cluster").agg(*total), "sizes")
    least, most = CHUNK_ROWS
    chunks = F.greatest(F.ceil(F.col("n") / F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("n") / 8)))), F.ceil(F.col("weight") / chunk_weight)).cast("int")
    own = members.join(sizes.filter(F.col("n") <= giant).select("cluster", chunks.alias("chunks")), "cluster").select("same", "cluster", F.lit(None).cast("long").alias("band"), "copies", "chunks")
    chained = members.join(sizes.filter(F.col("n") > giant).select("cluster"), "cluster").join(hits.select("same", "band"), "same")
    in_band = chained.groupBy("band").agg(*total).select("band", chunks.alias("chunks"))
    meet = own.unionByName(chained.join(in_band, "band").select("same", "cluster", "band", "copies", "chunks"))
    meet = meet.withColumn("chunk", F.pmod(F.xxhash64("same"), F.col("chunks")).cast("int"))
    meet = stored(meet.select("same", "cluster", "band", "chunk", "copies", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")), "meet")

    wanted = members.select("w_key", "w_hash")  # read from files, so that Spark knows its size
    rows = _rows(docs, key)
    texts = rows.join(wanted, rows["key"].eqNullSafe(wanted["w_key"]) & (rows["hash"] == wanted["w_hash"]), "left_semi").select("text")
    sets = stored(texts.mapInArrow(lean(_sets), "same binary, windows binary, sign binary").filter("same is not null").dropDuplicates(["same"]), "sets")
    dealt = sets.join(meet, "same").select("cluster", "band", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "same", "chunk", "copies", "windows", "sign")
    found = stored(dealt.groupBy("cluster", "band", "low", "high").applyInArrow(_links(threshold, tolerance), "same binary, links long, root binary"), "links")
    linked = found.groupBy("same").agg(F.sum("links").alias("links")).select(F.col("same").alias("l_same"), "links")
    roots = components(found.filter("same <> root").select(F.col("same").alias("a"), F.col("root").alias("b")), "groups")
    each = classes.join(linked, classes["same"] == linked["l_same"], "left").join(roots, F.col("same") == F.col("node"), "left")
    each = stored(each.select("same", "rep", F.coalesce("root", "same").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "linked")
    heads = each.groupBy("group").agg(F.min("rep").alias("head")).select(F.col("group").alias("h_group"), "head")
    return sketched.select("key", "hash", "same"), each.join(heads, each["group"] == heads["h_group"]).select("same", "head", "n_links")


def similar(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk_weight: int = CHUNK_WEIGHT, giant: int = GIANT) -> DataFrame:
    """(key, class_id, n_links) of every row of ``docs``: the least key of its connected group, and how many other rows have a similarity of ``threshold`` or more."""
    with small_batches(docs.sparkSession, 500):
        rows, classes = grouped(docs, key, threshold, tolerance, chunk_weight, giant)
    out = rows.join(classes, "same", "left")
    class_id = F.when(F.col("same").isNull(), F.col("key")).otherwise(F.col("head.key"))
    return out.select(F.col("key").alias(key), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", giant: int = GIANT) -> DataFrame:
    """Of each connected group of ``docs`` one row, the one with the least key, a null key last; texts without words all stay."""
    with small_batches(docs.sparkSession, 500):
        rows, classes = grouped(docs, key, THRESHOLD, TOLERANCE, CHUNK_WEIGHT, giant)
    key_, hash_, at = (unused(docs, c) for c in ("head_key", "head_hash", "at"))
    heads = stored(classes.select(F.col("head.key").alias(key_), F.col("head.hash").alias(hash_)).distinct(), "heads")
    wordless = rows.filter("same is null").select(F.col("key").alias(key_), F.col("hash").alias(hash_)).distinct()
    text_hash = F.xxhash64("text")
    match = F.col(key).eqNullSafe(F.col(key_)) & (text_hash == F.col(hash_))
    order = Window.partitionBy(key, text_hash).orderBy(F.lit(0))
    one = docs.join(heads, match, "left_semi").withColumn(at, F.row_number().over(order)).filter(F.col(at) == 1).drop(at)
    return one.unionByName(docs.join(wordless, match, "left_semi"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
