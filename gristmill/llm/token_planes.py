"""Token ids as files: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed.

Layout of a written set, three tables in one folder on any file system Spark writes to:

* ``chunks``: one row per block of ids: part, seq within the part, number of ids, width of an id in bytes, planes,
  and the documents in it: their number within the part, key, ids that lie in the block, and whether the document began
  before the block or goes on after it. A part is a range of keys in ascending order; each block of a part but the last
  holds ``CHUNK`` ids.
* ``parts``: per part the global number of its first id.
* ``index``: per block its part, seq, the global number of its first id, its ids and its size in bytes.

Spark's commit protocol writes them, so a lost executor's half-written files are never read. Every block is read by
itself; only documents that lie in several blocks are brought together.

Defined results: documents follow the key, null first, repeated keys in the order of a hash of their texts; a document
without ids keeps its row; an empty table writes empty tables; only the key and the ids are written.
"""

from __future__ import annotations

import functools
import itertools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encode_in_place, small_batches
from .common import lean, scratch_dir, table

CHUNK = 1 << 16
_CHUNKS = "part int, seq int, n int, width int, planes array<binary>, docs array<int>, keys array<long>, sizes array<int>, before boolean, after boolean"


def to_planes(ids: np.ndarray, unit: str = "bit", level: int = 1) -> tuple[int, list[bytes]]:
    """Bytes per id, and the compressed planes, lowest first; 2 bytes if that holds every id, else 4."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    rows = np.ascontiguousarray(ids, f"<u{width}").view(np.uint8).reshape(-1, width)
    if unit == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(rows.T)
    z = zstandard.ZstdCompressor(level=level)
    return width, [z.compress(p.tobytes()) for p in planes]


def from_planes(n: int, width: int, planes: list[bytes]) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(z.decompress(p), np.uint8) for p in planes]
    if len(planes) == 8 * width:  # eight planes make a byte of each id
        bits = (np.unpackbits(p, count=n, bitorder="little") << np.uint8(k % 8) for k, p in enumerate(rows))
        rows = [functools.reduce(operator.ior, itertools.islice(bits, 8)) for _ in range(width)]
    return np.stack(rows, axis=1).view(f"<u{width}").reshape(-1).astype(np.uint32)


def in_key_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) by ranges of the key, each sorted: the order of the files."""
    order = [F.asc_nulls_first(key), F.col("tie")]
    rows = docs.select(key, "text").withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")


def write(ordered: DataFrame, path: str, key: str = "doc_id", end_id: int | None = 0, unit: str = "bit", chunk: int = CHUNK) -> None:
    """Write ``ordered`` (key long, ids), whose partitions and rows are in file order. ``end_id`` ends every document."""
    spark = ordered.sparkSession
    small_batches(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, doc, held, n_held, before = TaskContext.get().partitionId(), 0, 0, [], 0, False
        docs: list[int] = []
        keys: list[int | None] = []
        sizes: list[int] = []

        def block(after: bool) -> pa.RecordBatch:
            width, planes = to_planes(np.concatenate(held) if held else np.empty(0, np.uint32), unit)
            row = {"part": part, "seq": seq, "n": n_held, "width": width, "planes": planes, "docs": docs, "keys": keys, "sizes": sizes, "before": before, "after": after}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy().astype(np.uint32)
            ends = np.cumsum(np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)), dtype=np.int64).tolist()
            begin = 0
            for k, end in zip(batch.column(0).to_pylist(), ends, strict=True):
                own = flat[begin:end] if end_id is None else np.append(flat[begin:end], np.uint32(end_id))
                begin, at = end, 0
                while True:
                    some = own[at : at + chunk - n_held]
                    docs.append(doc)
                    keys.append(k)
                    sizes.append(len(some))
                    held.append(some)
                    n_held, at = n_held + len(some), at + len(some)
                    if n_held == chunk:
                        yield block(at < len(own))
                        seq, held, n_held, before, docs, keys, sizes = seq + 1, [], 0, at < len(own), [], [], []
                    if at == len(own):
                        break
                doc += 1
        if docs:
            yield block(False)

    lists = [("docs", pa.int32()), ("keys", pa.int64()), ("sizes", pa.int32())]
    schema = pa.schema([*((c, pa.int32()) for c in ("part", "seq", "n", "width")), ("planes", pa.list_(pa.binary())), *((c, pa.list_(t)) for c, t in lists), ("before", pa.bool_()), ("after", pa.bool_())])
    ordered.select(F.col(key).cast("long").alias("key"), "ids").mapInArrow(lean(blocks), _CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    totals = chunks.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")
    size = F.aggregate("planes", F.lit(0), lambda s, p: s + F.octet_length(p))
    based = chunks.select("part", "seq", "n", size.alias("bytes")).join(spark.read.parquet(f"{path}/parts"), "part")
    based.select("part", "seq", (F.col("base") + F.col("seq").cast("long") * chunk).alias("first_id"), "n", "bytes").write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in the files under ``path``.

    ``start`` counts the ids of all documents before; the checksum is over ids as little-endian 32-bit integers.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = from_planes(row["n"], row["width"], row["planes"]).astype("<u4").tobytes()
                ends = np.cumsum(row["sizes"])
                begins, last = (ends - row["sizes"]).tolist(), len(ends) - 1
                own = [raw[4 * a : 4 * b] for a, b in zip(begins, ends.tolist(), strict=True)]
                split = [(i == 0 and row["before"]) or (i == last and row["after"]) for i in range(len(own))]
                sums = [None if s else zlib.crc32(x) for s, x in zip(split, own, strict=True)]
                n = len(own)
                out = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["docs"], pa.int32()), pa.array(row["keys"], pa.int64())]
                out += [pa.array(begins, pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(sums, pa.int64())]
                out.append(pa.array([x if s or with_ids else None for s, x in zip(split, own, strict=True)], pa.binary()))
                yield pa.record_batch(out, ["part", "seq", "doc", "key", "at", "n", "crc", "raw"])

    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    small_batches(spark)
    found = chunks.mapInArrow(lean(pieces), "part int, seq int, doc int, key long, at long, n long, crc long, raw binary")
    first = spark.read.parquet(f"{path}/index").select("part", "seq", "first_id")
    placed = found.join(first, ["part", "seq"])
    each = placed.groupBy("part", "doc").agg(F.first("key").alias("key"), F.min(F.col("first_id") + F.col("at")).alias("start"), F.sum("n").alias("n_tokens"), F.max("crc").alias("crc"), F.sort_array(F.collect_list(F.struct("seq", "raw"))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.coalesce(F.hex(p["raw"]), F.lit(""))), ""))  # joined once, however many blocks
    each = each.withColumn("raw", F.when(F.col("crc").isNull() | F.lit(with_ids), whole))
    out = each.select("key", "start", "n_tokens", F.coalesce("crc", F.crc32("raw")).alias("ids_crc32"), "raw")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("raw").to_pylist()]
            yield pa.record_batch([*batch.columns[:4], pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names[:4], "ids"])

    out = out.mapInArrow(ids, "key long, start long, n_tokens long, ids_crc32 long, ids array<long>") if with_ids else out.drop("raw")
    return out.withColumnRenamed("key", key)


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "planes")
    write(encode_in_place(in_key_order(table(spark, sf_dir, "documents"))), path)
    return read(spark, path, with_ids=False)
