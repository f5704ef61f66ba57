"""Each operator against a plain version on a small fixture; edge cases: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm import bpe, common, mixing, nearest, ngram_join, quality_classifier, quality_rules, secret_scans, suffix_dedup, token_planes, url_filters
from gristmill.llm.common import stored as common_stored
from gristmill.llm.common import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.Generator(np.random.PCG64(1))
VOCABULARY = ["".join(RNG.choice(list("etaoinshrdlu"), int(n))) for n in RNG.integers(2, 9, 300)]
SECRET = "to" + "ken = '" + "ab12" * 8 + "'"


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def fixture():
    base = [prose(120) for _ in range(12)]
    texts = [None, "", "   \n\t", "one two", base[0], base[0], base[1], base[1] + " and more", base[1].replace(" ", "  "), base[2] + "\n" + base[2], *base[3:]]
    texts += [SECRET, f"x {SECRET} AKIA{'Q7' * 10}\n{SECRET}", "### a&&& b%%% " * 40, "é 😀 ß <|endoftext|> \u3000 x  ", "-" * 700, prose(5000)]
    return [(i, t, ["en", "fr", None, "xx"][i % 4], ["b", "a", None][i % 3], i, "extra") for i, t in enumerate(texts)]


ROWS = fixture()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated_words(words):
    c = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if c[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality_counts(spark, docs, none):
    measured = quality_rules.measure(docs)
    got = {r["doc_id"]: r for r in quality_rules.verdict(measured, quality_rules.references(measured)).collect()}
    for i, t, *_ in ROWS:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert [r[f"q_{k}"] for k in ("n_words", "word_chars", "symbol", "dup_lines", "repeat_words")] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated_words(w)], i
        failed = len(w) < 10 or 100 * repeated_words(w) > 20 * len(w)
        assert r["q_base_failed"] == failed and not (failed and r["q_kept"])
    assert quality_rules.kept_documents(none).count() == 0
    assert quality_rules.kept_documents(docs).columns == docs.columns


def test_js_distance(spark):
    row = spark.createDataFrame([([1, 0], [0, 1], [3, 3])], "a array<bigint>, b array<bigint>, c array<bigint>")
    d = row.select(*(quality_rules.js_distance(F.col(x), F.col(y)) for x, y in ("ab", "aa", "ac"))).first()
    assert d[0] == pytest.approx(1) and d[1] == pytest.approx(0) and 0 < d[2] < 1


def test_junk_diverges(spark):
    # the distance is to the language's reference: one document of symbols among many clean ones
    rows = [(i, prose(150), "en") for i in range(40)] + [(99, " ".join(w + "&&&%%" for w in prose(150).split()), "en")]
    kept = {r["doc_id"] for r in quality_rules.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(40))


def test_long_texts_without_common_words_are_dropped(spark):
    def text(share, n=300):
        common = RNG.choice(quality_rules.COMMON_WORDS["en"], n)
        return " ".join(c if RNG.random() < share else w for c, w in zip(common, RNG.choice(VOCABULARY, n), strict=True))

    rows = [(i, text(0.4), "en") for i in range(40)] + [(50, text(0.0, 12), "en"), (60, text(0.0), None), (98, text(0.0), "en"), (99, text(0.03), "en")]
    kept = {r["doc_id"] for r in quality_rules.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {*range(40), 50, 60}  # a short text and one of no listed language are not judged by common words


def spans(t):
    kinds = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A), ("AKIA[A-Z0-9]+", 0, 20, 0), ("[0-9a-f]+", 0, 24, 0)]
    return sorted((m.start(), k, m.end()) for k, (p, g, n, f) in enumerate(kinds) for m in re.finditer(p, t, f) if len(m[g]) >= n)


def test_secret_spans_and_ledger(spark, docs, none):
    ledger = secret_scans.Ledger(spark)
    extra = [(100, "sec" + "ret=to" + "ken: abcdefgh", "en", "a", 1, ""), (101, "ſecret=abcdefghij " + SECRET + " 😀 " + SECRET.upper(), "en", "a", 1, "")]
    more = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    for frame in (docs, more, more.unionByName(more)):  # the second increment scans two blobs, the third none
        got = defaultdict(list)
        for r in secret_scans.spans_of(frame, ledger).collect():
            got[r["doc_id"]].append([(x["start"], x["kind"], x["stop"]) for x in r["spans"] if x["kind"] < 3])
        for i, t, *_ in ROWS + (extra if frame is not docs else []):
            assert all(x == spans(t or "") for x in got[i]), i
    assert ledger.scanned(secret_scans.RULE_VERSION).count() == len({t or "" for _, t, *_ in ROWS + extra})
    assert secret_scans.spans_of(none, secret_scans.Ledger(spark)).count() == 0


def test_secret_redaction(docs):
    out = {r["doc_id"]: r["text"] for r in secret_scans.redacted(docs).collect()}
    for i, t, *_ in ROWS:
        if t is None:
            assert out[i] is None
        else:
            marked = list(t)
            for a, _, b in spans(t):
                marked[a:b] = "\u2588" * (b - a)
            assert out[i] == "".join(marked)


KEY_BODY = "\n".join(["MIIEow" + "aB3/" * 14] * 60 + ["q9+Zx1=="])
HEAD, END = "-----BEGIN RSA PRIV" + "ATE KEY-----", "-----END RSA PRIV" + "ATE KEY-----"


@pytest.mark.parametrize("secret", [
    f"{HEAD}\n{KEY_BODY}\n{END}",
    f"{HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,9F00\n\n{KEY_BODY}",  # no END line
    HEAD + KEY_BODY.replace("\n", "\\n") + "\\n" + END,
    f"{HEAD} {KEY_BODY}".replace("\n", " "),
    "github" + "_pat_" + "aB" * 11 + "_" + "c" * 58 + "D",
    "npm" + "_" + "aZ" * 18,
    "py" + "pi-" + "aZ_-" * 13,
    "sk" + "_live_" + "aZ9" * 8,
    "AI" + "za" + "aZ_-9" * 7,
    "S" + "K" + "0aF1" * 8,
    "S" + "G." + "aZ" * 11 + "." + "b" * 43,
    "dop" + "_v1_" + "0a" * 32,
    "dp" + ".pt." + "aZ" * 21 + "q",
    "M" + "aZ9" * 8 + "." + "ab-_12" + "." + "c" * 27,
    "wJal/rXUt+" * 4,
])
def test_whole_secrets_are_masked(spark, secret):
    text = f"before 😀\n{secret}\n(after) é"
    docs = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secret_scans.redacted(docs).collect()}
    assert out == {1: text.replace(secret, "\u2588" * len(secret)), 2: "plain"}


def test_no_secret_in_prose_or_long_runs(spark):
    texts = [f"a key starts with {HEAD} and its body follows, of any length.", "aZ" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secret_scans.redacted(docs).collect()}
    assert out == {0: texts[0].replace(HEAD, "\u2588" * len(HEAD)), 1: texts[1]}


def test_url_filters(spark):
    urls = [None, "no scheme", "http://", "https://A.Example.COM/en/71?x", "http://a.example.com/en/81#/en/7", "http://com/en/", "http://xcom/en/1", "ftp://b.net/de/1", "http://q.example.net/de/8", "http://s.org/es/\n1", "http://s.org?es/", "a://b://c/d"]
    urls += [f"http://bad.com/en/{i}" for i in range(60)] + [f"http://bad.com/zz/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "html", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filters.judge(pages).collect()}
    assert len(got) == len(urls)

    def parts(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    for i, u in enumerate(urls):
        host, path = parts(u)
        fit = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.text)
        if best:
            assert got[i]["verdict"] == best.verdict
    assert {got[i]["template"] for i in range(12, 72)} == {"/~en/<n>"} == {got[i]["template"] for i in range(72, 132)} and got[80]["verdict"] == "block"  # no rule: as the branch it is merged with
    assert url_filters.judge(pages.filter("false")).count() == 0


def test_url_templates_reject_by_purity(spark):
    # a slug that varies becomes a wildcard; the part without a rule follows its template's labels
    rules = (url_filters.Rule("spam.com", "/buy/a", "block"), url_filters.Rule("spam.com", "/buy/b", "block"), url_filters.Rule("ham.com", "/", "allow"))
    urls = [f"http://spam.com/buy/{c}{w}" for c in "abc" for w in VOCABULARY[:120]] + [f"http://ham.com/{w}/x" for w in VOCABULARY[:40]] + ["http://spam.com/about"] * 30
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filters.judge(pages, rules).filter("rule is null").groupBy("template", "verdict").count().collect()
    # a branch without labels of its own that looks unlike those with labels allows
    assert {(r["template"], r["verdict"]): r["count"] for r in got} == {("/buy/*", "block"): 120, ("/about", "allow"): 30}


def test_url_branches_merge_where_alike(spark):
    """Labels flow to branches with next segments of the same kinds, but not to others; opposite labels keep branches apart."""
    rules = (url_filters.Rule("a.com", "/bad/", "block"), url_filters.Rule("a.com", "/good/", "allow"))
    urls = [f"http://a.com/{b}/{i}" for b in ("bad", "like") for i in range(80)] + [f"http://a.com/good/{i}" for i in range(60)]
    urls += [f"http://a.com/words/{w}" for w in VOCABULARY[:80]] + ["http://b.com/like/1"] * 80
    got = url_filters.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules)
    seen = {(r["host"], r["template"], r["verdict"], r["rule"] is None) for r in got.collect()}
    assert seen == {("a.com", "/~bad/<n>", "block", False), ("a.com", "/~bad/<n>", "block", True), ("a.com", "/good/<n>", "allow", False), ("a.com", "/words/*", "allow", True), ("b.com", "/like/<n>", "allow", True)}


def test_long_chains_of_segments_take_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(url_filters, "stored", lambda df, name: steps.append(name) or common_stored(df, name))
    chain = "/".join(f"s{chr(97 + i % 26)}" for i in range(200))
    urls = [f"http://trap.com/{chain}/{c}/{chain}" for c in ("x", "y") for _ in range(30)] + ["http://trap.com/" + chain] * 3
    got = url_filters.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"))
    # both branches of the fork go on alike, so they are merged
    assert {r["template"] for r in got.collect()} == {f"/{chain}/~x/{chain}", f"/{chain}"}
    assert len([s for s in steps if s.startswith("step")]) <= 5


def test_url_purity_is_smoothed(spark):
    """By hand; deep branches keep their own labels, and no host judges another."""
    rules = (url_filters.Rule("a.bad.com", "/x", "block"), url_filters.Rule("ok.com", "/", "allow"), url_filters.Rule("mix.com", "/1/2/3/4/5/s", "block"), url_filters.Rule("mix.com", "/1/2/3/4/5/g", "allow"))
    urls = [f"http://a.bad.com/x/{w}" for w in VOCABULARY[:100]] + [f"http://b.bad.com/{w}" for w in VOCABULARY[:5]] + [f"http://ok.com/{w}" for w in VOCABULARY[:80]]
    urls += [f"http://mix.com/1/2/3/4/5/{c}/{w}" for c in ("sp", "gd") for w in VOCABULARY[:60]] + ["http://mix.com/other"] * 25 + ["http://new.org/x"] * 25 + ["http://a.bad.com/" + "d/" * 400]
    got = defaultdict(set)
    for r in url_filters.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules).collect():
        got[r["host"], r["template"].count("/"), r["rule"] is None].add((r["verdict"], round(r["purity"], 4)))
    prior, smooth = 160 / 300, lambda b, n, p: (b + 10 * p) / (n + 10)
    bad, mix = smooth(100, 100, prior), smooth(60, 120, prior)
    assert got["a.bad.com", 2, False] == {("block", round(smooth(100, 100, bad), 4))} and got["a.bad.com", 400, True] == {("allow", round(bad, 4))}
    assert got["mix.com", 7, False] == {("block", round(smooth(60, 60, mix), 4)), ("allow", round(smooth(0, 60, mix), 4))}
    assert got["mix.com", 1, True] == {("allow", round(mix, 4))} and got["b.bad.com", 1, True] == got["new.org", 1, True] == {("allow", round(prior, 4))}


def reference_ids(t):
    from tokenizers import Tokenizer

    tok = reference_ids.__dict__.setdefault("tok", Tokenizer.from_file(tokenizer_path()))
    e = tok.encode(t or "", add_special_tokens=False)
    return e.ids, tok.decode(e.ids, skip_special_tokens=False)


ODD = ["a  b\n\n c", "x <|endoftext|> y<|endoftext|><|endoftext|>  <|endoftext|>z  ", "it's we'll I'M 'S", " 　\x1c\x1d x\x85y", "١٢٣ ① ²", "\U0001fae8 \U00010d4a z", "don't  '  s'tt", "<|endoftext|", " <|endoftext|> \r\n\t"]


def test_bpe_round_trip(spark, docs, none):
    rows = ROWS + [(200 + i // 2, t, "en", "a", 1, "") for i, t in enumerate(ODD * 2)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter((i, tuple(reference_ids(t)[0]), reference_ids(t)[1]) for i, t, *_ in rows)
    for encoded in (bpe.encode(frame, block_words=500), bpe.encode_in_place(frame, block_words=500)):
        assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.decode(encoded).collect()) == want
    assert bpe.encode(none).count() == 0
    broken = spark.createDataFrame([(1, [108, 120]), (2, [])], "doc_id long, ids array<int>")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    assert [r["decoded"] for r in bpe.decode(broken).orderBy("doc_id").collect()] == [tok.decode([108, 120]), ""]


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_token_planes(spark, docs, none, tmp_path, unit):
    token_planes.write(bpe.encode_in_place(token_planes.in_key_order(docs)), f"{tmp_path}/{unit}", unit=unit, chunk=1000)
    got = {r["doc_id"]: r for r in token_planes.read(spark, f"{tmp_path}/{unit}").collect()}
    at = 0
    for i, t, *_ in ROWS:
        ids = [*reference_ids(t)[0], 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    index = spark.read.parquet(f"{tmp_path}/{unit}/index").collect()
    assert sum(r["n"] for r in index) == at and len({r["first_id"] for r in index}) == len(index)
    token_planes.write(bpe.encode_in_place(token_planes.in_key_order(none)), f"{tmp_path}/none")
    assert token_planes.read(spark, f"{tmp_path}/none").count() == 0
    wide = np.array([1, 1 << 20, 7], np.uint32)
    assert (token_planes.from_planes(3, *token_planes.to_planes(wide, unit)) == wide).all()


def test_plain_texts_are_those_of_the_named_ranges(spark):
    named = [(0, 0x7F), *((c, c) for c in (0xA1, 0xA7, 0xA9, 0xAB, 0xAE, 0xB0, 0xB7)), (0xBB, 0xBB), (0xBF, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E)]
    chars = [chr(c) for c in [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0xFFFD, 0x1F600]]
    texts = ["", "é a" * 200_000, "é a" * 200_000 + "中", *(t for c in chars for t in (c, f"ab{c}", f"é{c}a"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.col("text").rlike(bpe._PLAIN).alias("plain")).collect()
    assert {r["k"]: r["plain"] for r in rows} == {k: all(any(a <= c <= b for a, b in named) for c in map(ord, set(t))) for k, t in enumerate(texts)}


def test_words_of_printable_ascii_take_the_short_way():
    encoder = bpe.Encoder.of(tokenizer_path())
    for w in ["".join(map(chr, range(32, 127))), " the", "\x7f", " \t", "a\x00", " é", "~" * 40]:
        assert encoder.word(w) == [t.id for t in encoder.model.tokenize(w.encode().decode("latin-1").translate(encoder.map))]


def test_workers_give_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def task(batches):
        for n in batches:
            held = [bytes(50_000) for _ in range(n)]
            kept.append(bytes(100))  # stands above them on the heap
            yield len(held)

    kept, before = [], resident()
    assert list(common.lean(task)(iter([4000, 10]))) == [4000, 10]
    assert resident() - before < 60 << 20
    assert common.lean_call(lambda a, b: a + b, 1, 2) == 3


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    encoder = bpe.Encoder(tokenizer_path())
    for k in range(20):
        block = [f" word{i}" for i in range(10 * k, 10 * k + 30)] + [" the", "x" * 100, "<|endoftext|>", " ", "é"]
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.all_words(block, [1 + (k + i) % 3 for i in range(len(block))])] == [encoder.word(w) for w in block]
        assert len(encoder.known) + len(encoder.older) <= 2 * (50 + len(block)) and "x" * 100 not in encoder.known


def test_sorted_suffixes():
    texts = [RNG.integers(97, 97 + a, n).astype(np.uint8).tobytes() for a, n in ((1, 300), (2, 400), (26, 2000))] + [b"a" * 250 + b"xyz" * 80 + b"\xff" + b"a" * 400 + b"b\xff"]
    for t in texts:
        t += b"\0"
        position, shared = (np.concatenate(x) for x in zip(*suffix_dedup.sorted_suffixes(np.frombuffer(t, np.uint8), 1 << 10), strict=True))
        own = [t[i : i + 100] for i in position]
        assert own == sorted(own, reverse=True) and sorted(position) == list(range(len(t) - 1))
        for k in range(1, len(own)):
            n = next((j for j, (a, b) in enumerate(zip(own[k], own[k - 1], strict=False)) if a != b), min(len(own[k]), len(own[k - 1])))
            assert shared[k] == n


def removed(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, none):
    rows = [(i, t) for i, t, *_ in ROWS] + [(50 + i, t) for i, t in enumerate(["a" * 99, "a" * 101, "x" * 50 + "a" * 300, "ab" * 200, "b" + "ab" * 120, "q\x00w" * 60, "q\x00w" * 60 + "é" * 80, prose(60) + ROWS[10][1][50:400] + prose(60)])]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == removed(rows)
    assert suffix_dedup.deduplicated(none).count() == 0


def test_regions_go_to_shards_by_more_than_a_gram():
    # random bytes around 16 that two texts share meet no string of the other; a passage of 100 bytes and a period do
    rng = np.random.default_rng(5)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8)

    def regions(*parts):
        return suffix_dedup.Regions(np.concatenate(parts), np.cumsum([len(p) for p in parts]))

    common, passage, period = letters(16), letters(100), np.tile(letters(30), 10)
    around = [regions(np.concatenate([letters(300), common, letters(300)])) for _ in range(50)]
    values, sides = (np.concatenate([getattr(r, c) for r in around]) for c in ("value", "sides"))
    assert len(np.unique(values)) < len(values) and len(np.unique(sides)) == len(sides)
    for shared in (passage, period):
        for _ in range(20):
            one, two = (regions(np.concatenate([letters(int(rng.integers(0, 200))), shared, letters(int(rng.integers(0, 200)))])) for _ in range(2))
            assert len(np.intersect1d(one.sides, two.sides))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_of_strings_at_every_place(spark, seed):
    # copies of 99 to 180 bytes from anywhere, some over few letters, so that grams repeat inside and outside them
    rng = np.random.default_rng(seed)
    pool = ["".join("abcdefghij"[i] for i in rng.integers(0, n, 400)) for n in (1, 2, 2, 3, 10, 10)]
    rows = []
    for k in range(40):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            source, n = pool[int(rng.integers(len(pool)))], int(rng.integers(99, 181))
            at = int(rng.integers(0, len(source) - n))
            parts += ["".join("abcdefghij"[i] for i in rng.integers(0, 10, int(rng.integers(0, 60)))), source[at : at + n]]
        rows.append((k, "".join(parts)))
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == removed(rows)


def test_mixing(spark, docs, none):
    sizes = mixing.sized(docs)
    rows = mixing.drawn(sizes, mixing.plan(sizes)).collect()
    total, source = {}, {}
    for i, t, _, s, *_ in ROWS:
        total[s] = total.get(s, 0) + len(WORD.findall(t or ""))
        source[i] = s
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    left = float(sum(total.values()))
    while free:  # share by weight, cap, share again
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.discard(s)
    taken = Counter()
    for r in rows:
        assert r["m_target"] == pytest.approx(target[source[r["doc_id"]]]) and r["m_source_size"] == total[source[r["doc_id"]]]
        assert len(r["m_shards"]) <= 3
        taken[source[r["doc_id"]]] += r["m_size"] * len(r["m_shards"])
    for s in order:  # no document that was left out of the last pass would still fit
        own = [r for r in rows if source[r["doc_id"]] == s and r["m_size"]]
        left_out = [r["m_size"] for r in own if len(r["m_shards"]) == min(len(x["m_shards"]) for x in own)]
        assert taken[s] <= target[s] + 1e-6 and (target[s] - taken[s] < min(left_out) or target[s] == 3 * total[s])
    assert mixing.mixture(docs).count() == sum(len(r["m_shards"]) for r in rows)
    assert mixing.mixture(none).count() == 0


def test_splitting_tree():
    quotas = np.array([1000, 10, 0, 333])
    tree = lambda *some: np.array([n for _, _, n in mixing.splitting_tree(quotas, 7, *some)])
    out = tree()
    assert (out.sum(axis=0) == quotas).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 3 and (out == tree()).all()
    assert (np.vstack([tree(0, 3), tree(3, 4), tree(4, 7)]) == out).all()  # tasks walk their own part
    assert ([start.tolist() for _, start, _ in mixing.splitting_tree(quotas, 7)] == (np.cumsum(out, axis=0) - out)).all()


def test_shares_come_from_tasks(spark):
    rows = mixing.shares(spark, [("=a", 1000), ("=b", 0), ("=c", 77)], 20).collect()
    for name, total in (("=a", 1000), ("=b", 0), ("=c", 77)):
        own = sorted((r["first"], r["n"]) for r in rows if r["m_source"] == name)
        assert sum(n for _, n in own) == total and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert mixing.shares(spark, [], 1).count() == 0


def jaccard(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root, links = {i: i for i in sets}, Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i: (root[i], links[i]) for i in sets}


def near_copies():
    texts = [t for _, t, *_ in ROWS]
    for base in (prose(200), prose(60)):
        w = base.split()
        for k in range(25):
            own = w.copy()
            for p in RNG.integers(0, len(own), k % 6):
                own[p] = "edit" + str(k)
            texts.append(" ".join(own))
    return list(enumerate(texts))


@pytest.mark.parametrize(("weight", "giant"), [(1 << 20, 1 << 15), (300, 1 << 15), (300, 2)])
def test_ngram_join(spark, weight, giant):
    rows = near_copies()
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_weight=weight, giant=giant)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == jaccard(rows)


def test_ngram_join_with_repeated_ids(spark):
    texts = [t for _, t in near_copies()]
    rows = [(k, (i % 9 if i % 4 else None, t)) for k, (i, t) in enumerate(enumerate(texts * 2))]
    groups = jaccard([(k, t) for k, (_, t) in rows])  # by row; ids are labels
    least = {}
    for k, (i, _) in rows:
        root = groups[k][0]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    frame = spark.createDataFrame([x for _, x in rows], "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in ngram_join.similar(frame).collect())
    wordless = {k for k, (_, t) in rows if not WORD.search(t or "")}
    assert got == Counter((i, i if k in wordless else least[groups[k][0]], groups[k][1]) for k, (i, _) in rows)
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(frame).collect())
    assert sum(kept.values()) == len(wordless) + len({groups[k][0] for k, _ in rows if k not in wordless})
    assert all((i, t) in kept for k, (i, t) in rows if k in wordless)


def test_one_of_each_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 0, 7, "x"), (2, "a b c d e f", 1, 8, "y"), (None, "a b c d e f", 2, 9, "z"), (None, "q r s t u v", 3, 9, "z"), (None, "q r s t u v", 3, 9, "z"), (3, None, 4, 9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, head_key int, same string")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter([rows[0], rows[3], rows[5]])
    assert ngram_join.one_of_each(docs.filter("false")).count() == 0


def test_ngram_join_edges(spark, none):
    assert ngram_join.similar(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (2, None, 0), (2, "", 0)], "doc_id long, text string, key int")
    assert sorted((r["doc_id"], r["n_links"]) for r in ngram_join.similar(twice).filter("doc_id is not null").collect()) == [(1, 2), (1, 2), (2, 0), (2, 0)]
    assert ngram_join.least_matches(0.8, 1e-6, 240) < 0.8 * 240


def test_nearest(spark):
    x = np.random.Generator(np.random.PCG64(4)).normal(size=(900, 16)).astype(np.float32)
    x[:30] = x[0] * 3  # longer than the others, so that equal vectors come first
    x[40] = 0
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 16, 1), (1020, [], 1), (None, x[1].tolist(), 1)]
    got = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), every=20, k=5, block=256).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    hits = 0
    asked = [i for i in range(0, 900, 20) if i != 40]
    assert sorted(got) == asked
    for q in asked:
        s = d @ d[q]
        s[[q, 40]] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        assert all(score == pytest.approx(s[i], abs=1e-9) for i, score in got[q])
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
    assert hits >= 0.9 * 5 * len(asked)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[20]] == [0, 1, 2, 3, 4]


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    walk = grid[np.argsort(nearest.hilbert(grid, 3))]
    assert sorted(nearest.hilbert(grid, 3)) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_quality_classifier(spark):
    rows = [(i, prose(60) if i % 3 else " ".join(w + "%%" for w in prose(60).split())) for i in range(600)] + [(900, None), (901, "")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(600)] + [(5000, 1, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    vectors = quality_classifier.word_vectors(docs)
    net = quality_classifier.fit(docs, known, vectors)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, vectors, net).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert quality_classifier.fit(docs, known.filter("quality = 1"), vectors).score(np.zeros((1, 1)))[0] == 1.0
    assert quality_classifier.scored(docs.filter("false"), vectors, net).count() == 0
    unlabelled = quality_classifier.fit(docs, known.filter("false"), vectors)
    assert {r["score"] for r in quality_classifier.scored(docs.limit(5), vectors, unlabelled).collect()} == {0.5}


def brute_nearest(x, ids, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        s[q] = -np.inf
        out[int(ids[q])] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def found_nearest(spark, x, ids, **options):
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.nearest(frame, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    return dict(got)


def test_nearest_with_one_query_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ORDERINGS", 2)
    x = np.random.Generator(np.random.PCG64(5)).normal(size=(5000, 8))  # three batches and more a task, most without a query
    ids = np.arange(1, 5001)
    assert found_nearest(spark, x, ids, every=5000, k=5) == brute_nearest(x, ids, 5000, 5)


@pytest.mark.parametrize("most", [nearest.MOST, 1])
def test_nearest_with_some_very_long_vectors(spark, most):
    rng = np.random.Generator(np.random.PCG64(6))
    x = rng.normal(size=(3000, 8))
    x[:20] *= 1000
    x[20:40] *= 1e-3
    ids = np.arange(3000)
    got, want = found_nearest(spark, x, ids, every=30, k=5, block=128, most=most, recall=1.1 if most == 1 else 0.95), brute_nearest(x, ids, 30, 5)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert got == want if most == 1 else hits >= 0.9 * 5 * len(want)  # beyond the bound of orderings the search is exact


@pytest.mark.parametrize("found", [0, 3, 6])
def test_exact_tiles_give_what_beats_the_finds(spark, monkeypatch, found):
    """All pairs that beat the finds so far, and of those beside them few others; bands of length that cannot are left out."""
    monkeypatch.setattr(nearest, "EXACT_VALUES", 8 * 70)
    monkeypatch.setattr(nearest, "EXACT_LEAST", 50)
    rng, k = np.random.Generator(np.random.PCG64(8)), 5
    x = rng.normal(size=(600, 8))
    x[:100] *= 1e-4
    x[100:130] *= 50
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pts = nearest.stored(nearest.points(nearest.usable(frame), 7, k), "points")
    scores = nearest.stored(nearest.brute_force(pts, pts.filter("is_query"), k), "truth")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    so_far = scores.withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= found).drop("at")
    got = nearest.exact_search(pts, so_far, k).toPandas()
    best = defaultdict(list)
    for q, c, score in zip(got["q"], got["c"], got["score"], strict=True):
        best[q["low"]].append((-score, c["low"]))
    asked = range(0, 600, 7)
    for q in asked:
        s = x @ x[q]
        assert [c for _, c in sorted(best[q])[: k + 1]] == np.lexsort((np.arange(600), -s))[: k + 1].tolist()
    assert len(got) == (k + 1) * len(asked) if found > k else len(got) > 3 * (k + 1) * len(asked)


def test_clashing_names_pass(spark, docs):
    own = docs.withColumns({"q_words": F.lit(1), "q_kept": F.lit("x"), "m_size": F.lit(2), "m_shard": F.lit(3), "found_blob": F.lit("b"), "s_spans": F.lit(4)})
    for out in (quality_rules.kept_documents(own), secret_scans.redacted(own), ngram_join.one_of_each(own)):
        assert out.columns == own.columns and out.filter("q_words = 1 and q_kept = 'x' and m_size = 2 and m_shard = 3 and found_blob = 'b' and s_spans = 4").count() == out.count() > 0
    mixed = mixing.mixture(own)
    assert mixed.columns == [*own.columns, "_m_shard"] and mixed.filter("m_size = 2 and m_shard = 3").count() == mixed.count() > 0


def test_no_machine_local_scratch_on_a_cluster():
    from types import SimpleNamespace

    from gristmill.llm import common

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://a:7077", applicationId="x"))
    with pytest.raises(RuntimeError):
        common.scratch_dir(unset, "y")
