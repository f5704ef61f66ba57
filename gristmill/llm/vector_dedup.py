"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A vector's code is the signs of its coordinates after random rotations; with it are stored the correction factor (the inner product
of the unit vector with its code) and the rotated vector in four bits a coordinate. The code of one vector and
the four bits of the other, divided by the factor, estimate their cosine without bias; the spread of that estimate is
known, and a pair is dropped if even ``EPSILON`` spreads above its estimate do not reach the threshold. What is left is
computed exactly, in double precision.

Pairs are met in buckets: further signs are cut into bands, whose width grows with the logarithm of the number of
vectors, so that a bucket holds about ``BUCKET`` unrelated ones; as many bands are used as make a pair at the threshold miss
all of them with a chance of ``MISS``. A pair counts in the first band that it shares only. Buckets of more than ``CHUNK``
vectors are cut into chunks, each pair of chunks a task. Buckets hold codes; vectors are sent only for members
of a bucket that have a pair left in it, and each task gives one row per vector, never one per pair.

Equal vectors are one class. Defined results: vectors that are null, empty, zero or hold a null or a non-finite component link
with nothing and are their own component; so are rows with a null id, whose component is null and which are not kept; vectors of
different lengths never link; each of several rows of one id gets its own row; a component is named by its smallest id; an
empty table gives an empty result; only the id and the vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import stored, table
from .nearest import usable
from .ngram_join import components

THRESHOLD = 0.95
#: Spreads of the estimate within which a pair is kept (one in 50 million falls outside, were they normal).
EPSILON = 5.5
MISS, BUCKET = 1e-7, 128
CHUNK, BLOCK = 4096, 256
_NODE = "struct<low:long,h:long>"
_AT = ["dims", "band", "key", "low_chunk", "high_chunk"]


def bands_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(signs in a band, number of bands) for ``n`` vectors."""
    width = max(1, round(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 1
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log1p(-agree))


@lru_cache(maxsize=4)
def _rotations(dims: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Random rotations beside each other, and the fixed offsets at which four-bit coordinates are rounded."""
    rng = np.random.Generator(np.random.PCG64([11, dims]))
    turns = []
    for _ in range(1 + -(-bits // dims)):
        q, r = np.linalg.qr(rng.normal(size=(dims, dims)))
        turns.append(q * np.sign(np.diag(r)))
    return np.hstack(turns), rng.random(dims)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)


def _bytes(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def codes(v: np.ndarray, width: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, sketch, keys) of each row of ``v``: packed signs for the estimate; factor, offset and step (float32) with the
    four-bit coordinates; and the key of each band, from the signs of the further rotations."""
    dims = v.shape[1]
    turns, dither = _rotations(dims, width * bands)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    turned = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turns
    own = turned[:, :dims]
    low = own.min(axis=1, keepdims=True)
    step = np.maximum((own.max(axis=1, keepdims=True) - low) / 15, 1e-12)
    levels = np.clip((own - low) / step + dither, 0, 15).astype(np.uint8)
    levels = np.hstack([levels, np.zeros((len(v), dims % 2), np.uint8)])
    factor = np.abs(own).sum(axis=1, keepdims=True) / np.sqrt(dims)
    sketch = np.hstack([np.hstack([factor, low, step]).astype("<f4").view(np.uint8), levels[:, ::2] << 4 | levels[:, 1::2]])
    signs = turned[:, dims : dims + width * bands] > 0
    keys = signs.reshape(len(v), bands, width) @ (1 << np.arange(width, dtype=np.int64))
    return np.packbits(own > 0, axis=1), sketch, keys


def _sketches(width: int, bands: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == d))
                code, sketch, keys = codes(_matrix(own.column("v")), width, bands)
                packed = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.record_batch([*(own.column(c) for c in ("node", "dims", "copies")), packed(code), packed(sketch), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "dims", "copies", "code", "sketch", "keys"])

    return run


class _Members:
    """The rows of a task: two chunks of a bucket (or one with itself), equal first keys beside each other in each."""

    def __init__(self, key: tuple, rows: pa.Table, threshold: float, epsilon: float) -> None:
        self.dims, self.band, _, low, high = (k.as_py() for k in key)
        chunk, keys = rows.column("chunk").to_numpy(), _matrix(rows.column("keys")).astype(np.int64)
        order = np.lexsort((keys[:, 0], chunk))
        self.rows, self.keys = rows.take(pa.array(order)), keys[order]
        self.same, self.half = low == high, int((chunk == low).sum())
        self.threshold = threshold
        sketch = _bytes(self.rows.column("sketch"), np.uint8)
        factor, offset, step = (x[:, None] for x in np.ascontiguousarray(sketch[:, :12]).view("<f4").T)
        levels = np.stack([sketch[:, 12:] >> 4, sketch[:, 12:] & 15], axis=2).reshape(len(sketch), -1)[:, : self.dims]
        self.turned = (offset + step * levels).astype(np.float32)
        signs = np.unpackbits(_bytes(self.rows.column("code"), np.uint8), axis=1)[:, : self.dims]
        self.code = (signs.astype(np.float32) * 2 - 1) / (np.sqrt(self.dims) * factor)
        # the part of a vector beside its code is spread evenly over the other directions, and never longer than itself
        beside = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * math.sqrt(1 - threshold**2)
        self.spread = np.minimum(epsilon / math.sqrt(max(self.dims - 1, 1)), 1) * beside
        self.rounding = epsilon * step / 2
        self.factor = factor

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose first shared band is this one and whose cosine may reach the threshold, in blocks."""
        n, first = len(self.keys), self.keys[:, 0]
        for a in range(0, self.half, BLOCK):
            b = min(a + BLOCK, self.half)
            start = a if self.same else self.half
            if self.band and self.same and first[a] == first[b - 1]:  # all of them have met in the first band
                start = int(np.searchsorted(first, first[a], "right"))
            for c in range(start, n, 4 * CHUNK):
                d = min(c + 4 * CHUNK, n)
                estimate = self.code[a:b] @ self.turned[c:d].T
                # what the code leaves open, and what the rounding of the other vector does
                near = estimate >= self.threshold - self.spread[a:b] - self.rounding[c:d].T / self.factor[a:b]
                if self.same:
                    near &= np.arange(a, b)[:, None] < np.arange(c, d)
                i, j = np.nonzero(near)
                i, j = i + a, j + c
                for k in range(self.band):
                    if not len(i):
                        break
                    new = self.keys[i, k] != self.keys[j, k]
                    i, j = i[new], j[new]
                if len(i):
                    yield i, j


def _flags(threshold: float, epsilon: float):  # noqa: ANN202
    """Members of a bucket that have a pair left."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        members = _Members(key, rows, threshold, epsilon)
        hit = np.zeros(len(rows), bool)
        for i, j in members.pairs():
            hit[i] = hit[j] = True
        left = members.rows.filter(pa.array(hit))
        return pa.table([*(pa.array([k.as_py()] * len(left), t) for k, t in zip(key, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)), left.column("node"), left.column("chunk")], [*_AT, "node", "chunk"])

    return task


def _links(threshold: float, epsilon: float):  # noqa: ANN202
    """Per member of a bucket its exact links there, and the least class that they connect it with."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        members = _Members(key, rows, threshold, epsilon)
        rows = members.rows
        v = _matrix(rows.column("v"))
        v /= np.abs(v).max(axis=1, keepdims=True)
        norm, copies = np.linalg.norm(v, axis=1), rows.column("copies").to_numpy()
        node = rows.column("node").combine_chunks()
        order = np.lexsort((node.field("h").to_numpy(), node.field("low").to_numpy()))
        root = np.empty(len(v), np.int64)
        root[order] = np.arange(len(v))
        links = np.zeros(len(v), np.int64)
        for i, j in members.pairs():
            for c in range(0, len(i), 1 << 15):
                x, y = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                near = np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y]) >= threshold
                x, y = x[near], y[near]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                _lower(root, order, x, y)
        return pa.table([node, pa.array(links), node.take(pa.array(order[root]))], ["node", "links", "root"])

    return task


def _lower(root: np.ndarray, order: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lower the roots (places in ``order``) of linked members to the least among them."""
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for at in (order[root[x]], order[root[y]], x, y):
            np.minimum.at(root, at, low)
        root[:] = root[order[root]]
        if (root == before).all():
            return


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, epsilon: float = EPSILON, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    valid = usable(vectors, id_col, vector)
    classes = valid.groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # several vectors of one id may be least of their class; the hash keeps them apart
    classes = stored(classes.select(F.struct("low", F.xxhash64("v").alias("h")).alias("node"), F.size("v").alias("dims"), "copies", "v"), "vectors")
    width, bands = bands_for(classes.count(), threshold, miss)
    with small_batches(spark, 10_000):
        sketched = classes.select("node", "v", "dims", "copies").mapInArrow(_sketches(width, bands), f"node {_NODE}, dims int, copies long, code binary, sketch binary, keys array<long>")
        sketched = stored(sketched, "codes")
        banded = sketched.select("node", "dims", F.posexplode("keys").alias("band", "key"))
        sizes = banded.groupBy("dims", "band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = stored(sizes.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n"), "sizes")
        met = banded.join(sizes, ["dims", "band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        met = met.select("node", "dims", "band", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        met = stored(met.select(F.col("node").alias("m_node"), "dims", "band", "key", F.least("chunk", "other").alias("low_chunk"), F.greatest("chunk", "other").alias("high_chunk"), "chunk"), "buckets")
        sketch = sketched.drop("dims")
        left = met.join(sketch, met["m_node"] == sketch["node"]).select(*_AT, "chunk", "node", "code", "sketch", "keys")
        left = stored(left.groupBy(*_AT).applyInArrow(_flags(threshold, epsilon), f"dims int, band int, key long, low_chunk int, high_chunk int, node {_NODE}, chunk int"), "left")
        full = sketch.join(classes.select(F.col("node").alias("v_node"), "v"), sketch["node"] == F.col("v_node")).select(F.col("node").alias("f_node"), "copies", "code", "sketch", "keys", "v")
        exact = left.join(full, left["node"] == full["f_node"]).select(*_AT, "chunk", "node", "copies", "code", "sketch", "keys", "v")
        found = stored(exact.groupBy(*_AT).applyInArrow(_links(threshold, epsilon), f"node {_NODE}, links long, root {_NODE}"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links")).select(F.col("node").alias("l_node"), "links")
    roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "near")
    each = classes.join(links, classes["node"] == links["l_node"], "left").join(roots.select(F.col("node").alias("r_node"), "root"), classes["node"] == F.col("r_node"), "left")
    each = stored(each.select("v", F.coalesce("root.low", "node.low").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("own_links")), "linked")
    rows = valid.select("id", F.col("v").alias("row_v")).join(each, F.col("row_v") == each["v"]).select(F.col("id").alias(id_col), F.col("own_links").alias("n_links"), F.col("component").alias("component_id"))
    lone = _unusable(vectors, id_col, vector).select(F.col(id_col).cast("long").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    out = rows.unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _unusable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector)
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return vectors.filter(F.col(id_col).isNull() | v.isNull() | bad | ~F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
