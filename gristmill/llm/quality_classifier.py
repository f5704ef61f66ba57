"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Every word has a sparse ternary index vector; the vector of a word is its own index vector plus the sum of those of its
neighbours at all its occurrences in the corpus. Words fall into ``BUCKETS`` by hash, so the table of vectors is
bounded and can be broadcast. A document is the mean and the spread of its words' vectors, its length and its variety.
The network is fitted on at most ``FIT_ROWS`` labelled documents, in the order of a hash of their ids; a fifth of them
are held back to fit the temperature. The corpus statistics cover every document.

Defined results: null and empty texts are documents without words and get a score; a label that is null, or whose
document is absent, is not learned from; a document labelled twice is learned twice; without labels of both kinds
every score is the share of label 1 (0.5 without labels); repeated rows each get their row; an empty table gives an empty
result; a null id has a score, and null for whether it is held out; labels, lang, source and ids are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_batches
from .common import split_words, stored, table

BUCKETS, DIMS, REACH = 1 << 14, 32, 2
FIT_ROWS, HIDDEN, EPOCHS, RATE, BATCH = 20_000, 32, 40, 3e-3, 128
CALIBRATION = 5
FOLDS, THRESHOLD = 5, 0.3
SEED = 3


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.choice(np.array([-1, 0, 0, 0, 0, 1], np.int8), size=(buckets, dims))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, number of its document in the batch, distinct words of each document."""
    sizes, flat = split_words(texts)
    coded = flat.dictionary_encode()
    buckets = np.array([xxhash.xxh32_intdigest(w) % BUCKETS for w in coded.dictionary.to_pylist()], np.int32)
    at = coded.indices.to_numpy() if len(coded) else np.empty(0, np.int32)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    distinct = np.unique(doc << 32 | at)
    return buckets[at] if len(at) else at, doc, np.bincount(distinct >> 32, minlength=len(sizes))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total, seen = index_vectors().astype(np.float64), np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        codes, doc, _ = _coded(batch.column("text"))
        seen += np.bincount(codes, minlength=BUCKETS)
        same = [doc[o:] == doc[:-o] for o in range(1, REACH + 1)]
        for d in range(DIMS):
            own = index[codes, d]
            near = own.copy()
            for o, within in enumerate(same, 1):
                near[o:] += own[:-o] * within
                near[:-o] += own[o:] * within
            total[:, d] += np.bincount(codes, weights=near, minlength=BUCKETS)
    some = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(some, pa.int32()), *(pa.array(total[some, d].astype(np.int64)) for d in range(DIMS))], ["bucket", *(f"d{d}" for d in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors by bucket, from all of ``docs``; BUCKETS * DIMS numbers whatever the input."""
    small_batches(docs.sparkSession, 500)
    split = docs.select("text")
    sums = split.mapInArrow(_contexts, "bucket int, " + ", ".join(f"d{d} long" for d in range(DIMS)))
    rows = sums.groupBy("bucket").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS)]).toArrow()
    vectors = np.zeros((BUCKETS, DIMS))
    vectors[rows.column("bucket").to_numpy()] = np.stack([rows.column(f"d{d}").to_numpy() for d in range(DIMS)], axis=1)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of features per document."""
    codes, doc, distinct = _coded(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    by = np.maximum(n, 1)
    mean, spread = np.empty((len(texts), DIMS)), np.empty((len(texts), DIMS))
    for d in range(DIMS):
        v = vectors[codes, d].astype(np.float64)
        mean[:, d] = np.bincount(doc, weights=v, minlength=len(texts)) / by
        spread[:, d] = np.sqrt(np.maximum(np.bincount(doc, weights=v * v, minlength=len(texts)) / by - mean[:, d] ** 2, 0))
    return np.column_stack([mean, spread, np.linalg.norm(mean, axis=1), np.log1p(n), distinct / by, np.log1p(distinct)])


class Network:
    """Standardised inputs, one hidden layer of ReLU, one logit; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> None:
        self.share, self.temperature, self.weights = float(y.mean()) if len(y) else 0.5, 1.0, None
        if not len(y) or not 0 < self.share < 1:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.Generator(np.random.PCG64(SEED))
        x = self._standard(x)
        w = [rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        fit, step = np.flatnonzero(~calibration), 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for i in range(0, len(fit), BATCH):
                some, step = fit[i : i + BATCH], step + 1
                hidden = np.maximum(x[some] @ w[0] + w[1], 0)
                slope = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - y[some]) / len(some)
                back = np.outer(slope, w[2]) * (hidden > 0)
                grads = [x[some].T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * w[2], slope.sum(keepdims=True)]
                for j, g in enumerate(grads):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.001 * (g * g - v[j])
                    w[j] -= RATE * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        if calibration.any():
            logit, own = self._logit(x[calibration]), y[calibration]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, logit / t) - own * logit / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logit(self._standard(x)) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, fit_rows: int = FIT_ROWS) -> Network:
    """Learns from rows of ``labels`` (doc_id, quality) that are not held out."""
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), "quality")
    some = stored(known.orderBy(F.xxhash64(F.lit(SEED), "l_id"), "l_id").limit(fit_rows), "labels")
    held = spark.sparkContext.broadcast(vectors)
    small_batches(spark, 500)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), held.value)
            yield pa.record_batch([batch.column("l_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["l_id", "quality", "x"])

    rows = docs.join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("l_id", F.col("quality").cast("int"), "text")
    got = rows.mapInArrow(features, "l_id long, quality int, x array<double>").toArrow().sort_by([("l_id", "ascending"), ("quality", "ascending")])
    y = (got.column("quality").to_numpy() > 0).astype(np.float64)
    x = np.array(got.column("x").to_pylist()).reshape(len(y), -1 if len(y) else 0)
    calibration = np.array([xxhash.xxh32_intdigest(str(i)) % CALIBRATION == 0 for i in got.column("l_id").to_pylist()], bool)
    return Network(x, y, calibration)


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of ``docs``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((vectors, network))
    small_batches(spark, 500)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, net = held.value
        for batch in batches:
            yield pa.record_batch([batch.column("key"), pa.array(net.score(pooled(batch.column("text"), table_)))], ["key", "score"])

    split = docs.select(F.col(key).alias("key"), "text")
    return split.mapInArrow(score, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = word_vectors(docs)
    out = scored(docs, vectors, fit(docs, labels, vectors))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
