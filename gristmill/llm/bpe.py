"""BPE encoding and decoding over a table of distinct words.

Encoding: Spark splits texts into the tokenizer's words; blocks of documents keep word numbers by position and send
each of their distinct words to a bucket of the distinct-word table; there each distinct word of the corpus is encoded
once; the ids go back to the blocks and are joined by position. Decoding joins ids to the pieces of the vocabulary,
whose size is that of the tokenizer (broadcast), and concatenates bytes.

Only byte-level BPE files without a normaliser are served, for which the ids of a text are those of its words.
Plain texts (ASCII, Latin letters, common punctuation) travel whole and are split at changes of byte classes, all texts of a
batch at once; other texts are split by Java's regular expressions, and those with code points that Java's Unicode
tables do not know by the tokenizer itself. All three give the same words.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows each get their row; a
null id decodes to nothing; ids outside the vocabulary are an error; an empty table gives an empty result; only the key
and the text are read. A block is closed at ``BLOCK_WORDS`` words or ``BLOCK_BYTES`` bytes of them, whichever comes first, and holds
one Arrow batch (16 MB, or one longer document) more at most, so a task's memory is bounded by the longest document.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, lean_call, table, text_or_empty, tokenizer_path

BLOCK_WORDS = 1 << 21
#: Texts of few but very long words end a block by their bytes.
BLOCK_BYTES = 1 << 27
#: Words whose ids a Python worker keeps between blocks: at most twice as many and a block's words, each of bounded length.
KEPT_WORDS, KEPT_LENGTH = 1 << 17, 32
_WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


#: Plain texts, for Java: beyond ASCII some punctuation and the Latin letters up to U+017F. Runs of ASCII pass one comparison a
#: character; possessive, so that Java neither goes back nor deeper with the length of a text.
_PLAIN = r"\A[\x00-\x7F]*+(?:[\x{A1}\x{A7}\x{A9}\x{AB}\x{AE}\x{B0}\x{B7}\x{BB}\x{BF}-\x{17F}\x{2010}-\x{2027}\x{2030}-\x{205E}]++[\x00-\x7F]*+)*+\z"
_OTHER, _LETTER, _DIGIT, _BLANK, _AS_BEFORE = range(5)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xc3\xc4\xc5", _LETTER), (b"0123456789", _DIGIT), (b" \t\n\x0b\x0c\r", _BLANK)):
        out[np.frombuffer(chars, np.uint8)] = kind
    out[0x80:0xC0] = _AS_BEFORE
    return out


_CLASSES = _byte_classes()


def split_plain(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of plain texts that end at ``ends``; words follow each other without gaps.

    A word is a run of letters, of digits or of other characters, with the blank before it; an apostrophe that starts a word takes one
    of the endings s, t, m, d, re, ve, ll along; of white space before a word the last character stands apart.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kind = _CLASSES[data]
    after = np.flatnonzero(kind == _AS_BEFORE)
    for _ in range(2):  # characters of two and three bytes
        kind[after] = kind[after - 1]
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    kind[signs] = kind[signs + 1] = _OTHER
    edge = np.zeros(n + 1, bool)  # texts begin here
    edge[ends[ends <= n]] = edge[0] = True
    begins = edge.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins)
    start, stop = run[:-1], run[1:]
    own = kind[start]
    blank = own == _BLANK
    led = np.zeros(len(start), bool)  # the run has a blank of its own before it
    led[1:] = blank[:-1] & ~blank[1:] & (data[start[1:] - 1] == 0x20) & ~edge[start[1:]]
    apart = stop[blank & ~edge[stop] & (stop - start > 1)] - 1
    begins[start[led]] = False
    begins[apart] = True
    mark = start[(own == _OTHER) & (stop - start == 1) & ~led & ~edge[stop]]
    mark = mark[(data[mark] == 0x27) & (kind[np.minimum(mark + 1, n - 1)] == _LETTER)]
    if len(mark):
        first, second = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
        two = ~edge[mark + 2] & (((first == 0x72) | (first == 0x76)) & (second == 0x65) | (first == 0x6C) & (second == 0x6C))
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        for some, size in ((one, 1), (two & ~one, 2)):
            at = mark[some]
            begins[at + 1] = False
            begins[at + 1 + size] = True
    begins[n] = False
    return np.flatnonzero(begins)


class small_batches:  # noqa: N801
    """Documents may be long: keep Arrow batches to ``rows`` rows and 16 MB.

    As a context it holds for what is run inside and the settings before come back; a plain call holds for the
    session, for operators whose result is run by the caller.
    """

    def __init__(self, spark: SparkSession, rows: int = 1000) -> None:
        self.conf = spark.conf
        names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
        self.before = {n: spark.conf.get(n) for n in names}
        for name, bound in zip(names, (1 << 24, rows), strict=True):
            if not 0 < int(self.before[name].rstrip("b")) <= bound:
                spark.conf.set(name, str(bound))

    def __enter__(self) -> None:
        return None

    def __exit__(self, *_: object) -> None:
        for name, value in self.before.items():
            self.conf.set(name, value)


class Vocabulary:
    """A byte-level BPE file: its special strings, its model, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(re.match(r"[\s\w]", s) for s in self.specials) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: a special token that is not set off by punctuation")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.vocab = spec["model"]["vocab"]

    def java_words(self) -> str:
        """The pattern of one word, for Java. Special strings are words and end the text before them."""
        special = "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        ahead, guard, own = (f"|(?={special})", f"(?!{special})", f"{special}|") if special else ("", "", "")
        # letters and digits first: neither apostrophes nor special strings begin like them; possessive, as nothing is given back
        return rf" ?\p{{L}}++| ?\p{{N}}++|{own}'(?:[stmd]|re|ve|ll)| ?(?:{guard}[^{_WHITE}\p{{L}}\p{{N}}])++|[{_WHITE}]+(?:(?![^{_WHITE}]){ahead})|[{_WHITE}]+"

    def pieces(self) -> pa.Array:
        """Bytes by id."""
        byte = {c: b for b, c in self.letters.items()}
        out: list[bytes | None] = [None] * (max([*self.vocab.values(), *self.specials.values()]) + 1)
        for piece, i in self.vocab.items():
            out[i] = bytes(byte[c] for c in piece)
        for piece, i in self.specials.items():
            out[i] = piece.encode()
        return pa.array(out, pa.binary())


class Encoder:
    """Encodes single words; one for each Python worker and file."""

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.vocabulary, tokenizer = Vocabulary(path), Tokenizer.from_file(path)
        self.model, self.pre, self.map = tokenizer.model, tokenizer.pre_tokenizer, {b: c for b, c in self.vocabulary.letters.items()}
        self.specials, self.blank = self.vocabulary.specials, self.map[0x20]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def word(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        # of printable ASCII only the blank has another letter
        letters = word.replace(" ", self.blank) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.map)
        return [t.id for t in self.model.tokenize(letters)]

    def all_words(self, words: list[str], counts: list[int]) -> list[bytes]:
        """The ids of each as 32-bit integers. Words met twice or more stay known for the worker's next blocks."""
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}  # words met since move over, the others are forgotten next time
        known, older, word, out = self.known, self.older, self.word, []
        for w, n in zip(words, counts, strict=True):
            ids = known.get(w)
            if ids is None:
                ids = older.get(w) or array("i", word(w)).tobytes()
                if n > 1 and len(w) <= KEPT_LENGTH:
                    known[w] = ids
            out.append(ids)
        return out

    def split(self, text: str) -> list[str]:
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            out += [part] if part in self.specials else [part[a:b] for _, (a, b) in self.pre.pre_tokenize_str(part)] if part else []
        return out


def _pack(*arrays: np.ndarray) -> list[bytes]:
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(np.ascontiguousarray(a).view(np.uint8).data) if len(a) else b"" for a in arrays]


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind) if data else np.empty(0, kind)


def _strings(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, strings.offset * 4)
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.empty(0, np.uint8)
    return offsets, data


def _bucket(strings: pa.Array, n: int) -> np.ndarray:
    """A bucket for each string, from its length and its first and last bytes."""
    offsets, data = _parts(strings)
    start, stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    h = (stop - start).astype(np.uint64)
    for j in range(8):
        for at in (start + j, stop - 1 - j):
            inside = (at >= start) & (at < stop)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ np.where(inside, data[np.where(inside, at, 0)] if len(data) else 0, 0).astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


class _Block:
    """The words of some documents: distinct ones in order of bucket, and their numbers by position.

    ``moves``: for each batch where its words stand among ``values``, if not in the order of its documents.
    """

    def __init__(self, keys: list, sizes: list, values: list, moves: list, n_buckets: int) -> None:
        self.keys, self.sizes = keys, np.concatenate(sizes) if sizes else np.empty(0, np.int32)
        coded = pa.chunked_array(values, pa.string()).combine_chunks().dictionary_encode()
        words = coded.dictionary
        buckets = _bucket(words, n_buckets)
        order = np.argsort(buckets, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.buckets = words.take(pa.array(order)), buckets[order]
        self.codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int32)
        begin = 0
        for own, move in zip(sizes, moves, strict=True):
            end = begin + int(own.sum())
            if move is not None:
                self.codes[begin:end] = self.codes[begin:end][move]
            begin = end


def _list_sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4))


def _plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each plain text has, and all of them: one array over the bytes of the texts."""
    offsets, data = _parts(texts)
    data, ends = data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
    begins = split_plain(data, ends)
    places = np.append(begins, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))
    return np.diff(np.searchsorted(begins, ends)).astype(np.int32), words


def _batch_words(batch: pa.RecordBatch, path: str) -> tuple[np.ndarray, list[pa.Array], np.ndarray | None]:
    """How many words each document of a batch has, all words by the way they are split, and where those of the documents, in
    their order, stand among them (None: in order)."""
    kind = batch.column("kind").to_numpy()
    sizes, values, rows = np.zeros(len(batch), np.int32), [], []
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        own = batch if len(at) == len(batch) else batch.take(pa.array(at))
        if k == PLAIN:
            n, words = _plain_words(own.column("text"))
        else:
            lists = own.column("words")
            if k == UNKNOWN:
                split = Encoder.of(path).split
                lists = pa.array([split(t) for t in own.column("text").to_pylist()], pa.list_(pa.string()))
            n, words = _list_sizes(lists), lists.flatten()
        sizes[at] = n
        values.append(words)
        rows.append(at)
    if len(rows) < 2:
        return sizes, values, None
    dealt = np.concatenate(rows)
    begin = np.empty(len(batch), np.int64)
    begin[dealt] = np.concatenate([[0], np.cumsum(sizes[dealt], dtype=np.int64)[:-1]])
    ends = np.cumsum(sizes, dtype=np.int64)
    return sizes, values, np.arange(int(ends[-1])) + np.repeat(begin - (ends - sizes), sizes)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, n_buckets: int, block_words: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, _Block]]:
    task, k, held, n_bytes = TaskContext.get().partitionId(), 0, 0, 0
    keys, sizes, values, moves = [], [], [], []
    for batch in batches:
        own, words, move = _batch_words(batch, path)
        keys.append(batch.column("key"))
        sizes.append(own)
        values += words
        moves.append(move)
        held += int(own.sum())
        n_bytes += batch.nbytes
        del own, words, move
        if held >= block_words or n_bytes >= block_bytes:
            block = _Block(pa.chunked_array(keys), sizes, values, moves, n_buckets)
            keys, sizes, values, moves = [], [], [], []  # the texts go before the block is used
            yield task << 32 | k, block
            del block
            k, held, n_bytes = k + 1, 0, 0
    if keys:
        block = _Block(pa.chunked_array(keys), sizes, values, moves, n_buckets)
        keys, sizes, values, moves = [], [], [], []
        yield task << 32 | k, block


#: How a text is split: at byte classes, by the tokenizer, by Java.
PLAIN, UNKNOWN, BY_JAVA = range(3)


def _split(docs: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    text = F.col("text")
    plain = (F.octet_length(text) == F.length(text)) | text.rlike(_PLAIN)
    for special in vocabulary.specials:
        plain = plain & ~text.contains(special)
    kind = F.when(plain, PLAIN).when(text.rlike(r"\p{Cn}"), UNKNOWN).otherwise(BY_JAVA)
    rows = docs.select(F.col(key).alias("key"), text_or_empty().alias("text")).select("*", F.inline(F.array(F.struct(kind.alias("kind")))))
    found = F.regexp_extract_all(text, F.lit(vocabulary.java_words()), F.lit(0))
    by_java = F.col("kind") == BY_JAVA
    return rows.select("key", "kind", F.when(by_java, found).otherwise(F.array().cast("array<string>")).alias("words"), F.when(by_java, "").otherwise(text).alias("text"))


def encode(docs: DataFrame, key: str = "doc_id", path: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, ids array<int>) of every row of ``docs``."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    small_batches(spark)
    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = _split(docs, key, Vocabulary(path))

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, path, n_buckets, block_words):
            offsets, data = _parts(b.words)
            edges = np.searchsorted(b.buckets, np.arange(n_buckets + 1))
            some = [i for i in range(n_buckets) if edges[i] < edges[i + 1]]
            packed = [_pack(np.diff(offsets[edges[i] : edges[i + 1] + 1]), data[offsets[edges[i]] : offsets[edges[i + 1]]]) for i in some]
            yield pa.record_batch([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["block", "bucket", "lengths", "data"])
            del b, offsets, data, packed  # before the next block is gathered

    def encode_bucket(rows: pa.Table) -> pa.Table:
        lengths = [_unpack(x, np.int32) for x in rows.column("lengths").to_pylist()]
        data = [bytes(_unpack(x, np.uint8)) for x in rows.column("data").to_pylist()]
        coded = pa.chunked_array([_strings(n, d) for n, d in zip(lengths, data, strict=True)]).combine_chunks().dictionary_encode()
        encoder = Encoder.of(path)
        ids = pa.array([encoder.word(w) for w in coded.dictionary.to_pylist()], pa.list_(pa.int32()))
        out, at = [], 0
        for n in map(len, lengths):
            own = ids.take(coded.indices[at : at + n])
            out.append(_pack(np.diff(own.offsets.to_numpy()).astype(np.int32), own.flatten().to_numpy()))
            at += n
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["block", "bucket", "sizes", "ids"])

    def codes_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, path, n_buckets, block_words):
            keys = pa.ListArray.from_arrays(pa.array([0, len(b.keys)], pa.int32()), b.keys.combine_chunks())
            sizes, codes = _pack(b.sizes.astype(np.int32), b.codes)
            yield pa.record_batch([pa.array([block], pa.int64()), keys, pa.array([sizes], pa.binary()), pa.array([codes], pa.binary()), pa.array([len(b.words)], pa.int32())], ["block", "keys", "sizes", "codes", "n_words"])
            del b, keys, sizes, codes

    def by_position(blocks: pa.Table, encoded: pa.Table) -> pa.Table:
        encoded = encoded.sort_by("bucket")
        lengths = np.concatenate([np.empty(0, np.int32), *[_unpack(x, np.int32) for x in encoded.column("sizes").to_pylist()]])
        flat = np.concatenate([np.empty(0, np.int32), *[_unpack(x, np.int32) for x in encoded.column("ids").to_pylist()]])
        if len(lengths) != blocks.column("n_words")[0].as_py():
            raise RuntimeError("a block was rebuilt with other words; is the input changing?")
        words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
        codes, sizes = _unpack(blocks.column("codes")[0].as_py(), np.int32), _unpack(blocks.column("sizes")[0].as_py(), np.int32)
        ids = words.take(pa.array(codes)).flatten()
        tokens = np.concatenate([[0], np.cumsum(lengths[codes], dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return pa.table([blocks.column("keys").combine_chunks().flatten(), pa.ListArray.from_arrays(pa.array(tokens[ends].astype(np.int32)), ids)], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    word_table = split.mapInArrow(lean(words_out), "block long, bucket int, lengths binary, data binary")
    encoded = word_table.groupBy("bucket").applyInArrow(lambda rows: lean_call(encode_bucket, rows), "block long, bucket int, sizes binary, ids binary")
    blocks = split.mapInArrow(lean(codes_out), f"block long, keys array<{kind}>, sizes binary, codes binary, n_words int")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(lambda own, words: lean_call(by_position, own, words), f"`{key}` {kind}, ids array<int>")


def encode_in_place(docs: DataFrame, key: str = "doc_id", path: str | None = None, block_words: int = BLOCK_WORDS // 2) -> DataFrame:
    """As ``encode``, without a shuffle: each block keeps a table of its own distinct words and encodes each once.

    Rows keep their partition and their order. Words that many blocks share are encoded once for each worker, or once
    more where it has forgotten them.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    small_batches(spark)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _blocks(batches, path, 1, block_words):
            encoder = Encoder.of(path)
            own = encoder.all_words(b.words.to_pylist(), np.bincount(b.codes, minlength=len(b.words)).tolist())
            lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(own), np.int32)))
            tokens = np.concatenate([[0], np.cumsum(lengths[b.codes], dtype=np.int64)])
            ends = tokens[np.concatenate([[0], np.cumsum(b.sizes, dtype=np.int64)])]
            keys, first = b.keys.combine_chunks(), 0
            while first < len(keys):  # batches of some million ids
                stop = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 21), side="right")) - 1)
                ids = words.take(pa.array(b.codes[slice(*np.searchsorted(tokens, ends[[first, stop]]))])).flatten() if ends[first] < ends[stop] else pa.array([], pa.int32())
                yield pa.record_batch([keys[first:stop], pa.ListArray.from_arrays(pa.array((ends[first : stop + 1] - ends[first]).astype(np.int32)), ids)], [key, "ids"])
                first = stop
            del b, own, words, tokens  # before the next block is gathered

    return _split(docs, key, Vocabulary(path)).mapInArrow(lean(encoded), f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ``ids``, malformed bytes replaced."""
    spark, path = encoded.sparkSession, path or tokenizer_path()
    small_batches(spark)
    pieces = spark.sparkContext.broadcast(Vocabulary(path).pieces().to_pylist())  # bounded by the vocabulary
    names = encoded.columns

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = pa.array(pieces.value, pa.binary())
        for batch in batches:
            lists = batch.column("ids")
            ends = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4) if len(lists) else np.zeros(1, np.int32)
            joined = by_id.take(lists.values)
            offsets = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, joined.offset * 4)
            data = joined.buffers()[2].to_pybytes() if joined.buffers()[2] else b""
            at = offsets[ends]
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lean(join_pieces), f"{fields}, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decode(encode(table(spark, sf_dir, "documents"))))


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of (key, ids, decoded)."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
