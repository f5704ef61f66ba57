"""Periodic runs against their definition, the count of comparisons, and the digests of a table with every edge case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(s, least):
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(all(s[x] == s[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, j + q - i, q))
            i = j
    return sorted(out)


def sequences(count):
    rnd = random.Random(13)
    for _ in range(count):
        n, k = rnd.randrange(60), rnd.choice([1, 2, 2, 3, 5])
        s = [rnd.randrange(k) for _ in range(n)]
        if n > 3 and rnd.random() < 0.5:
            p, a = rnd.randrange(1, n // 2 + 1), rnd.randrange(n)
            s = [s[i] if i < a else s[min(a + (i - a) % p, n - 1)] for i in range(n)]
        yield s + s[: rnd.randrange(n + 1)] + s if rnd.random() < 0.3 else s


def test_runs_are_those_of_the_definition():
    for s in sequences(1500):
        for least in (1, 12):
            assert R.runs(s, least) == plain_runs(s, least), s


def test_next_smaller_suffixes():
    for s in sequences(500):
        after, reach = R.next_smaller(s)
        for i, (j, same) in enumerate(zip(after, reach, strict=True)):
            assert j == next((x for x in range(i + 1, len(s)) if s[x:] < s[i:]), len(s))
            assert s[i : i + same] == s[j : j + same] and (j + same == len(s) or s[i + same] != s[j + same] or j == len(s))


class Counted(int):
    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [lambda n: [0] * n, fibonacci, lambda n: [i.bit_count() & 1 for i in range(n)], lambda n: ([0] * 50 + [1]) * (n // 51), lambda n: [x for i in range(int((2 * n) ** 0.5)) for x in [0] * i + [1]], lambda n: (fibonacci(n // 4) + [2]) * 4])
def test_comparisons_are_linear(make):
    for n in (2000, 32000):
        for sign in (1, -1):
            s = [Counted(sign * x) for x in make(n)]
            Counted.compared = 0
            list(R._runs_of_order(s, 1))
            assert Counted.compared <= 6 * len(s)


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    names = {x: i for i, x in enumerate(dict.fromkeys(w))}
    found = plain_runs([names[x] for x in w], 12)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def texts():
    rng = np.random.Generator(np.random.PCG64(3))
    words = [f"w{i}" for i in range(60)] + ["é", "😀x", "ﬁn"]
    prose = lambda n: " ".join(rng.choice(words, n))
    own = [None, "", " \n\t ", "one", "a a " * 40, "a b\n" * 3 + "a  b a b a\x0bb a b", "x y z " * 4 + "x y", prose(150), prose(30) * 3, (prose(9) + " ") * 5 + prose(20), "q " * 12, "q " * 11, (prose(7) + " ") * 2]
    own += [prose(int(k)) for k in rng.integers(1, 120, 60)]
    return [(i, t) for i, t in enumerate(own)] + [(3, "one"), (None, "b c " * 9), (-5, prose(50)), (90, "a b " * 20)]


def test_table_of_runs(spark, tmp_path):
    rows = texts()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, start int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = R.op13_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(plain_row(*r)) for r in rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert R.op13_runs(spark, str(tmp_path)).count() == 0


def test_general_interface_and_long_text(spark):
    long = "ab cd " * 30_000 + "end"
    df = spark.createDataFrame([("k1", long), ("k2", None)], "key string, body string").selectExpr("cast(substr(key, 2) as long) AS key", "body")
    got = {r["key"]: r for r in R.run_table(df, "key", "body").collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 60_000, 2)] and got[1]["collapsed"] == "ab cd end"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == ""


def test_single_words_cut_no_run():
    words = pa.array(["a b " * 20, "a b " * 20, " ".join(f"u{i}" for i in range(50)) + " z" * 12])
    found, collapsed = R.batch_runs(words, [None] * 3)
    assert found == [[(0, 40, 2)], [(0, 40, 2)], [(50, 12, 1)]] and collapsed.to_pylist()[0] == "a b"
