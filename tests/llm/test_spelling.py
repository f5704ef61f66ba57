"""Spelling variants against a plain comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from gristmill.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for k, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    links = {w: [x for x in count if near(w, x)] for w in count}
    form = {}
    for w, others in links.items():
        top = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = top if top and count[top] >= 10 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows():
    rnd = random.Random(12)
    stems = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(6, 10))) for _ in range(25)]
    long = "".join(rnd.choice("ab") for _ in range(63))
    stems += ["aaaaaaa", "aaaaaaaa", "aaabaaaa", "ÀÀÀÀÀÀÀà", "straßen×÷", long, long + "a", "b" + long + "a", "b" + long[:30] + "c" + long[31:] + "a"]
    texts = [(i, " ".join(rnd.choice(stems).upper() if rnd.random() < 0.1 else rnd.choice(stems[: 3 + i % 31]) for _ in range(rnd.randrange(80)))) for i in range(120)]
    texts += [(1, None), (2, ""), (None, "abcdefg abcdefg! abcdefh,abcdefh"), (3, "1" * 50), (8, "chained " * 400), (4, "chaine " * 5 + "chainedx " * 30 + "chainedxy " * 2), (5, "chained chained"), (5, "chained chained")]
    texts.append((7, ("q" * 5000 + " ") * 2 + ("q" * 4999 + " ") * 30))
    return texts


def test_variants(spark, tmp_path):
    data = rows()
    spark.createDataFrame([(k, t, "x", 5) for k, t in data], "doc_id long, text string, word string, n int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = S.op12_spelling(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, out.collect()), key=repr)
    want = plain(data)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] >= 3 for r in want) and any(len(r[0]) > 64 and r[4] for r in want)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert S.op12_spelling(spark, str(tmp_path)).count() == 0


def test_keys_are_distinct_deletions():
    words = ["aab", "b", "éàxx", "a" * 500]
    number, key, first, last = S.deletion_keys(pa.array(words))
    of = {}
    for w, k, a, b in zip(number.tolist(), key.tolist(), first.tolist(), last.tolist(), strict=True):
        for i in range(a, b + 1):
            text = words[w] if i < 0 else words[w][:i] + words[w][i + 1 :]
            assert of.setdefault(text, k) == k
    assert len(set(of.values())) == len(of)
    assert sorted(Counter(number.tolist()).values()) == sorted([1 + 2, 1 + 1, 1 + 3, 1 + 1])


@pytest.mark.parametrize("pair", [("abcdefg", "abcdefgg"), ("abcdefg", "xbcdefg"), ("aabbaab", "aabaab"), ("aabaaab", "aababab")])
def test_near_pairs_share_one_key(pair):
    number, key, *_ = S.deletion_keys(pa.array(pair))
    assert len(set(key[number == 0]) & set(key[number == 1])) == 1


def test_plain_counts(spark):
    df = spark.createDataFrame([("1", "Hello hello HELLO a bc"), ("2", None)], "k string, body string")
    assert [tuple(r) for r in S.word_counts(df, "k", "body", least=3).collect()] == [("hello", 3)]
