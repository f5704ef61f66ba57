"""Helpers shared by the training-data operators: table access, the cluster's scratch folder, words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` under ``sf_dir``, on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all machines share")
        base = f"{tempfile.gettempdir()}/gristmill-{os.getuid()}"
    return f"{base.rstrip('/')}/gristmill/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares (``spark.checkpoint.dir``).

    Only where that setting is absent (a local session, as in tests) a temporary folder takes its place.
    """
    return f"{_scratch(spark)}/{uuid.uuid4().hex}/{name}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written there, once no DataFrame that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def split_words(texts):  # noqa: ANN001, ANN201
    """The words of an Arrow array of texts: how many each has, and all of them in one array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[ \t-\r]+")
    flat = lists.flatten()
    sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)) if len(lists) else np.empty(0, np.int32)
    some = pc.not_equal(flat, "")  # white space at an end leaves an empty piece
    doc = np.repeat(np.arange(len(sizes)), sizes)[some.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
    return np.bincount(doc, minlength=len(sizes)), flat.filter(some) if len(flat) else pa.array([], pa.string())


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and stands beside those of later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(task: Callable) -> Callable:
    """``task`` for mapInArrow, after whose last batch memory is given back."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        give_back()

    return run


def lean_call(task: Callable, *tables):  # noqa: ANN002, ANN201
    """What ``task`` makes of a group's tables; its own memory is given back."""
    out = task(*tables)
    give_back()
    return out


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
