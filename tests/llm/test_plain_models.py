"""The quality classifier and the blocks of the tokenizer against plain versions."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gristmill.llm import bpe, secret_scans
from gristmill.llm import quality_classifier as qc
from gristmill.llm.common import tokenizer_path

RNG = np.random.Generator(np.random.PCG64(30))
WORDS = ["".join(RNG.choice(list("abcdefgh"), int(n))) for n in RNG.integers(1, 6, 60)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def bucket(word):
    return xxhash.xxh32_intdigest(word) % qc.BUCKETS


def plain_vectors(texts):
    """A word's own index vector and those of its neighbours within two places, summed over all its occurrences."""
    index, total = qc.index_vectors().astype(float), defaultdict(lambda: np.zeros(qc.DIMS))
    for t in texts:
        w = [bucket(x) for x in (t or "").split()]
        for i, x in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                total[x] += index[w[j]]
    out = np.zeros((qc.BUCKETS, qc.DIMS))
    for x, v in total.items():
        out[x] = v / np.linalg.norm(v) if v.any() else v
    return out


def plain_features(text, vectors):
    w = (text or "").split()
    v = np.array([vectors[bucket(x)] for x in w]) if w else np.zeros((0, qc.DIMS))
    mean = v.mean(axis=0) if w else np.zeros(qc.DIMS)
    spread = v.std(axis=0) if w else np.zeros(qc.DIMS)
    distinct = len(set(w))
    return [*mean, *spread, np.linalg.norm(mean), np.log1p(len(w)), distinct / max(len(w), 1), np.log1p(distinct)]


def test_vectors_features_and_scores(spark):
    texts = [prose(int(n)) for n in RNG.integers(1, 60, 80)] + [None, "", "one", "a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vectors = qc.word_vectors(docs)
    assert vectors == pytest.approx(plain_vectors(texts), abs=1e-5)
    want = np.array([plain_features(t, vectors.astype(float)) for t in texts])
    assert qc.pooled(pa.array(texts), vectors) == pytest.approx(want, abs=1e-4)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, quality int")
    net = qc.fit(docs, labels, vectors)
    hidden = np.maximum(np.clip((want - net.mean) / net.scale, -8, 8) @ net.weights[0] + net.weights[1], 0)
    logit = (hidden @ net.weights[2] + net.weights[3]) / net.temperature
    got = {r["doc_id"]: r["score"] for r in qc.scored(docs, vectors, net).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(list(1 / (1 + np.exp(-logit))), abs=1e-3)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vectors = qc.word_vectors(docs)
    assert not vectors.any()
    net = qc.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), vectors)
    assert qc.scored(docs, vectors, net).count() == 0


def test_ids_met_many_times_stay_bounded(spark):
    docs = spark.createDataFrame([(7, prose(20))] * 30 + [(8, prose(20))], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (7, 1)], "doc_id long, quality int")
    vectors = qc.word_vectors(docs)
    net = qc.fit(docs, labels, vectors)
    assert qc.scored(docs, vectors, net).count() == 31


def test_blocks_end_by_bytes():
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    texts = [["x" * 1000] for _ in range(50)]
    batches = [pa.record_batch([pa.array([i]), pa.array([bpe.BY_JAVA], pa.int32()), pa.array([t], pa.list_(pa.string())), pa.array([""])], ["key", "kind", "words", "text"]) for i, t in enumerate(texts)]
    before, bpe.TaskContext = bpe.TaskContext, Task
    try:
        blocks = list(bpe._blocks(iter(batches), "", 1, 1 << 21, 8000))
    finally:
        bpe.TaskContext = before
    assert sum(len(b.keys) for _, b in blocks) == 50 and max(len(b.keys) for _, b in blocks) <= 9


def test_long_words_and_deep_texts(spark):
    from tokenizers import Tokenizer

    texts = ["q" * 30_000, "q" * 30_000 + " tail", "é" * 5000, None, ""] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    plain = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs, block_words=3).collect()}
    again = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_in_place(docs, block_words=3).collect()}
    for i, t in enumerate(texts):
        assert got[i] == again[i] == plain.encode(t or "", add_special_tokens=False).ids


def test_plain_split_equals_the_tokenizer():
    split = bpe.Encoder.of(tokenizer_path()).split
    letters = list("abstmdrevlLS  '' '9 0\n\t\r.,!-é×÷ÀſŁ«°“–") + ["'s", "'re", " 'll", "'ve ", "\x1c", "\x00", "\x7f", "  ", "\n\n", "it's", "\u205e"]
    texts = ["", " ", "'", "'s", "a's", "a 's", "''s", "x'sy", "x'", "'r", "'re'", "a  b", "a \n b", "a\n", "  ", " é", "é's", "'é", "\n's", "×s"]
    texts += ["".join(RNG.choice(letters, int(n))) for n in RNG.integers(0, 25, 4000)]
    sizes, words = bpe._plain_words(pa.array(texts))
    got, at = words.to_pylist(), 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert got[at : at + n] == split(t), t
        at += n
    assert at == len(got)


def test_mixed_batches_keep_their_order(spark):
    from tokenizers import Tokenizer

    texts = [f"plain {i} text's é" if i % 3 else f"世界 {i} <|endoftext|> x" if i % 2 else f"a \u0378 {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    plain = Tokenizer.from_file(tokenizer_path())
    for encode in (bpe.encode, bpe.encode_in_place):
        rows = [(r["doc_id"], list(r["ids"])) for r in encode(docs).collect()]
        assert dict(rows) == {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert [i for i, _ in rows] == list(range(60))


def test_gates_are_in_every_match():
    own = {"access": ["AKIA" + "Q" * 16], "pem": ["-----BEGIN RSA PRIVATE KEY-----"], "forge": [f"gh{c}_" + "a" * 36 for c in "pousr"] + ["glpat-" + "a" * 20], "chat": [f"xox{c}-" + "1" * 20 for c in "abeoprs"], "jwt": ["eyJ" + "a" * 10 + (".b" + "c" * 9) * 2], "userinfo": ["://a:b@"], "forge_fine": ["github" + "_pat_" + "a" * 22 + "_" + "b" * 59], "npm": ["npm_" + "a" * 36], "pypi": ["pypi-" + "a" * 50], "stripe": ["sk_" + k + "_" + "a" * 24 for k in ("live", "test")], "google": ["AIza" + "a" * 35], "twilio": ["SK" + "a" * 32], "sendgrid": ["SG." + "a" * 22 + "." + "b" * 43], "docean": ["dop_v1_" + "a" * 64], "doppler": ["dp.pt." + "a" * 43]}
    for kind in secret_scans.KINDS:
        assert bool(kind.gate) == (kind.name in own)
        for text in own.get(kind.name, []):
            assert re.search(kind.pattern, text) and any(g in text for g in kind.gate), (kind.name, text)
            assert len({g for t in own[kind.name] for g in kind.gate if g in t}) == len(kind.gate)
