"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source falls into blocks of documents by hash. Its target fixes how often all its blocks are drawn and how many
blocks, in a permuted order, are drawn once more; in the block where the target is reached, documents are taken in
hash order as they fit. The drawn blocks are the quotas of the sources: a binary tree over the output shards
splits them exactly, each node by one multivariate-hypergeometric draw; each shard takes its share from the
source's permuted sequence, disjoint from all others, and is shuffled locally.

Defined results: sizes count words, a null text has none; sources are ordered by code point, the null source last;
targets are shares of all sizes by weight, at most ``MAX_EPOCHS`` times the source's size, what is over goes to the
others by weight; an empty source has target 0; repeated rows (same key and size) are taken together; an empty table
gives an empty result; the columns of the input pass under any names, the shard is ``m_shard`` or, where that is taken, that
with an underscore before it. Only one row per source reaches the driver; blocks per source are bounded by
``MAX_BLOCKS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored, table, text_or_empty, unused

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_DOCS, MAX_BLOCKS = 256, 1 << 20
DRAWS_PER_SHARD = 64
SEED = 20


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``m_source`` (never null), ``m_size`` and ``m_hash``."""
    return docs.withColumns({
        "m_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
        "m_size": F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"),
        "m_hash": F.xxhash64(F.lit(SEED), F.col(key)),
    })


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(m_source, m_source_size, m_docs, m_blocks, m_target) per source.

    With the sources in order of cap / weight, the first whose share of what is left stays under its cap gives
    the level of all that follow.
    """
    each = sizes.groupBy("m_source").agg(F.sum("m_size").alias("m_source_size"), F.count(F.lit(1)).alias("m_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("m_source") == "", "m_source")) - 1
    each = each.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.col("m_source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    order, whole = Window.orderBy("ratio", "m_source"), Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("level", (F.sum("m_source_size").over(whole) - capped) / left).withColumn("at", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(whole)
    each = each.withColumn("m_target", F.least(F.col("cap").cast("double"), first["level"] * F.col("w")))
    blocks = F.ceil(F.col("m_docs") / F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.col("m_docs") / MAX_BLOCKS))).cast("long")
    return each.select("m_source", "m_source_size", "m_docs", F.greatest(blocks, F.lit(1)).alias("m_blocks"), F.col("m_target"))


def splitting_tree(quotas: np.ndarray, shards: int, first: int = 0, stop: int | None = None, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first draw, number of draws by source) of the shards from ``first`` on: quotas are split exactly, equal numbers of
    draws per shard, up to one.

    Every node has a generator of its own, so a task walks only the nodes above its shards and agrees with all others.
    """
    stop = shards if stop is None else stop
    nodes = [(0, shards, np.zeros(len(quotas), np.int64), np.asarray(quotas, np.int64))]
    while nodes:
        low, high, start, own = nodes.pop()
        if high <= first or low >= stop:
            continue
        if high - low == 1:
            yield low, start, own
            continue
        mid, total = (low + high) // 2, int(own.sum())
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        some = rng.multivariate_hypergeometric(own, total * (mid - low) // (high - low), method="marginals") if total else own
        nodes += [(mid, high, start + some, own - some), (low, mid, start, some)]


def shares(spark: SparkSession, quotas: list[tuple[str, int]], shards: int) -> DataFrame:
    """(m_source, shard, first, n): what each shard takes of each source's sequence; the tree is walked in tasks."""
    names, counts = [s for s, _ in quotas], np.array([n for _, n in quotas], np.int64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of neighbouring shards
            own = batch.column("shard").to_numpy()
            rows = [(names[k], shard, int(start[k]), int(n[k])) for shard, start, n in splitting_tree(counts, shards, int(own[0]), int(own[-1]) + 1) for k in np.flatnonzero(n).tolist()] if len(own) else []
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["m_source", "shard", "first", "n"])

    return spark.range(shards).withColumnRenamed("id", "shard").mapInArrow(walk, "m_source string, shard int, first long, n long")


def _block(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("m_hash")), F.col("m_blocks"))


def plan(sizes: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """From sized documents: targets, draws by block (m_source, m_block, m_draws), and the documents chosen of boundary blocks."""
    spark = sizes.sparkSession
    goal = stored(targets(sizes), "targets")
    placed = sizes.join(goal, "m_source").withColumn("m_block", _block(sizes))
    blocks = stored(placed.groupBy("m_source", "m_block").agg(F.sum("m_size").alias("words")), "blocks").join(goal, "m_source")
    full = F.when(F.col("m_source_size") > 0, F.floor(F.col("m_target") / F.col("m_source_size"))).otherwise(0).cast("int")
    blocks = blocks.withColumn("full", full).withColumn("rest", F.floor(F.col("m_target") - F.col("full") * F.col("m_source_size")).cast("long"))
    passes = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("epoch"))
    order = Window.partitionBy("m_source", "epoch").orderBy(F.xxhash64(F.lit(SEED + 2), "epoch", "m_block"), "m_block")
    passes = passes.withColumn("stop", F.sum("words").over(order)).withColumn("rank", F.row_number().over(order) - 1)
    gap = F.col("rest") - (F.col("stop") - F.col("words"))
    last = F.col("epoch") == F.col("full")
    draws = passes.filter(~last | (gap > 0)).select("m_source", "m_block", "epoch", (F.col("epoch") * F.col("m_blocks") + F.col("rank")).alias("draw"), F.when(last & (F.col("stop") > F.col("rest")), gap).alias("gap"))
    draws = stored(draws, "draws")

    quotas = sorted((r["m_source"], r["n"]) for r in draws.groupBy("m_source").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per source
    shards = max(1, -(-sum(n for _, n in quotas) // DRAWS_PER_SHARD))
    dealt = shares(spark, quotas, shards).select("m_source", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("draw"))
    by_block = draws.join(dealt, ["m_source", "draw"]).groupBy("m_source", "m_block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "gap"))).alias("m_draws"))
    by_block = stored(by_block, "by_block")

    # the one block of a source where its target is reached: documents in hash order, each if it still fits
    edge = placed.join(draws.filter("gap is not null").select("m_source", "m_block", "gap"), ["m_source", "m_block"])
    edge = edge.groupBy("m_source", "m_block", "gap", "m_hash", key, "m_size").agg(F.count(F.lit(1)).alias("copies"))
    lists = edge.groupBy("m_source", "m_block", "gap").agg(F.sort_array(F.collect_list(F.struct("m_hash", F.col(key).alias("key"), "m_size", (F.col("copies") * F.col("m_size")).alias("all")))).alias("docs"))
    none = F.filter("docs", lambda d: F.lit(False))
    fold = F.aggregate("docs", F.struct(F.col("gap").alias("left"), none.alias("taken")), lambda s, d: F.when(d["all"] <= s["left"], F.struct((s["left"] - d["all"]).alias("left"), F.concat(s["taken"], F.array(d)).alias("taken"))).otherwise(s), lambda s: s["taken"])
    chosen = lists.select("m_source", "m_block", F.explode(fold).alias("d")).select(F.col("m_source").alias("c_source"), F.col("d.key").alias("c_key"), F.col("d.m_size").alias("c_size"), F.lit(True).alias("m_chosen"))
    return goal, by_block, stored(chosen, "chosen")


def drawn(sizes: DataFrame, planned: tuple[DataFrame, DataFrame, DataFrame], key: str = "doc_id") -> DataFrame:
    """Sized documents with ``m_target``, ``m_source_size`` and ``m_shards``, the shard of each copy that is taken."""
    goal, by_block, chosen = planned
    df = sizes.join(goal, "m_source", "left").withColumn("m_block", _block(sizes)).join(by_block, ["m_source", "m_block"], "left")
    df = df.join(chosen, (F.col("m_source") == F.col("c_source")) & F.col(key).eqNullSafe(F.col("c_key")) & (F.col("m_size") == F.col("c_size")), "left")
    kept = F.filter("m_draws", lambda d: d["gap"].isNull() | F.coalesce("m_chosen", F.lit(False)))
    shards = F.coalesce(F.transform(kept, lambda d: d["shard"]), F.array().cast("array<int>"))
    return df.withColumn("m_shards", shards).drop("m_draws", "m_chosen", "c_source", "c_key", "c_size", "m_block", "m_blocks", "m_docs")


def mixture(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each copy taken: the columns of ``docs`` and ``m_shard``, shuffled within each shard."""
    packed = docs.select(F.struct(*docs.columns).alias("m_doc"), key, source, "text")  # apart from the operator's own names
    sizes = sized(packed, key, source)
    small = stored(sizes.select(key, "m_source", "m_size", "m_hash"), "sized")
    rows = drawn(sizes, plan(small, key), key).select("m_doc", "m_hash", F.posexplode("m_shards").alias("m_copy", "m_shard"))
    mixed = rows.withColumn("m_at", F.xxhash64(F.lit(SEED + 3), "m_hash", "m_copy")).repartition("m_shard").sortWithinPartitions("m_shard", "m_at")
    return mixed.select("m_doc.*", F.col("m_shard").alias(unused(docs, "m_shard")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small = stored(sized(docs).select("doc_id", "m_source", "m_size", "m_hash"), "sized")
    out = drawn(small, plan(small))
    return out.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.size("m_shards")).alias("taken"), F.col("m_shards").alias("shards"))
