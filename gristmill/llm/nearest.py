"""Approximate nearest neighbours by largest inner product, over shifted space-filling curves.

Vectors are lifted so that the largest inner product is the nearest point, projected onto a few random directions,
shifted, and ordered along a Hilbert curve; Spark sorts several such orderings by range. Runs of ``BLOCK`` neighbours on a
curve form a block; a query is compared exactly with its own block and the two beside it, and the finds of all
orderings merge. Orderings are added until the recall that a bounded sample of queries shows against brute
force over all vectors reaches ``RECALL``. Where it does not before the orderings have shown each query ``EXACT_AT``
times as many places as there are points, or ``MOST`` orderings are done, the whole query set is compared with the
points in tiles, so that the target holds for any data. There a query goes only to bands of length whose longest vector could
still beat the last of its best finds, and a tile gives only what does beat it, so what the curves found keeps the results of tiles few.

Vectors are lifted and ordered by bands of their length (a factor of two each); a query looks into every band, so that a few very
long vectors do not crowd all others into a corner of the grid.

Equal vectors are one point of the curve; a point carries the smallest ids of its vectors, as many as one answer holds.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, neither as
queries nor as candidates; vectors of different lengths are never compared; a repeated id is one candidate with
several vectors and counts once with its best; null ids take no part; with fewer candidates than ``k`` all that
the blocks reach are given; an empty table gives an empty result; only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import small_batches
from .common import stored, table

K, DIMS, BITS, BLOCK = 20, 8, 7, 2048
ORDERINGS, MORE, MOST = 16, 8, 256
RECALL, SAMPLE = 0.95, 64
#: Places shown to a query, as a multiple of all points, from which on comparing it with all of them costs less.
EXACT_AT = 4
#: Numbers that each side of a tile of the exact comparison holds (32,768 vectors of 64 numbers), and the fewest vectors.
EXACT_VALUES, EXACT_LEAST = 1 << 21, 256
#: Part by which a sum of products may differ from another order of summing.
ROUNDING = 1e-9


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims), each coordinate of ``bits`` bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for k in range(bits - 1, -1, -1):
        for row in x:
            out = (out << 1) | ((row >> k) & 1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~zero).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def points(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(point, v, dims, norm2, band, ids, is_query): equal vectors together, with their k + 1 smallest ids."""
    first = Window.partitionBy("v").orderBy("id")
    ids = rows.distinct().withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
    ids = ids.groupBy("v").agg(F.min("id").alias("low"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter(F.pmod(F.col("id"), F.lit(every)) == 0).select("v").distinct().withColumn("is_query", F.lit(True))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    df = ids.join(asked, "v", "left").select("low", "v", F.size("v").alias("dims"), norm.alias("norm2"), "ids", F.coalesce("is_query", F.lit(False)).alias("is_query"))
    band = F.coalesce(F.round(F.log2(F.least("norm2", F.lit(1e300))) / 2), F.lit(-999)).cast("int")
    # a repeated id may be the smallest of two vectors; the vector's hash keeps their points apart
    return df.withColumn("band", band).withColumn("point", F.struct("low", F.xxhash64("v").alias("h")))


def _keys(batches: Iterator[pa.RecordBatch], orderings: range, tops: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """Places on the curves of every vector in its band, and of every query in all bands (``tops``: the longest of each, squared)."""
    names = ["ordering", "band", "key", "point", "is_query"]

    def rows(ordering: int, band: np.ndarray, key: np.ndarray, point: pa.Array, is_query: bool) -> pa.RecordBatch:
        n = len(key)
        return pa.record_batch([pa.array(np.full(n, ordering), pa.int32()), pa.array(band, pa.int32()), pa.array(key, pa.int64()), point, pa.array(np.full(n, is_query), pa.bool_())], names)

    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == d, pa.bool_()))
            v, norm2, band = _matrix(own.column("v")), own.column("norm2").to_numpy(), own.column("band").to_numpy()
            top = np.array([tops[b] for b in band.tolist()])
            lifted = np.nan_to_num(np.hstack([v, np.sqrt(np.maximum(top - norm2, 0))[:, None]]) / np.sqrt(top)[:, None])
            asked = own.column("is_query").to_numpy(zero_copy_only=False)
            queries = np.nan_to_num(np.hstack([v[asked] / np.sqrt(norm2[asked])[:, None], np.zeros((int(asked.sum()), 1))]))
            asking = own.column("point").filter(pa.array(asked, pa.bool_()))
            for o in orderings:
                rng = np.random.Generator(np.random.PCG64([o, d]))
                m = min(DIMS, d + 1)
                turn = np.linalg.qr(rng.normal(size=(d + 1, m)))[0]
                shift = rng.uniform(-0.5, 0.5, m)

                def place(at: np.ndarray) -> np.ndarray:
                    # coordinates of a unit vector spread by 1 / sqrt(d): six of that fill the grid
                    grid = ((at @ turn + shift / np.sqrt(d + 1)) * np.sqrt(d + 1) / 6 + 0.5) * (1 << BITS)  # noqa: B023
                    return hilbert(np.clip(grid, 0, (1 << BITS) - 1), BITS)

                yield rows(o * 100_000 + d, band, place(lifted), own.column("point"), False)
                if len(queries):
                    key = place(queries)
                    for b in tops:
                        yield rows(o * 100_000 + d, np.full(len(key), b), key, asking, True)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        yield pa.record_batch([pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64()), *(batch.column(c) for c in ("ordering", "point", "is_query"))], ["part", "at", "ordering", "point", "is_query"])
        at += n


def _rerank(k: int):  # noqa: ANN202
    def block(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        kind = (queries if len(queries) else candidates).column("point").type
        qv, cv = _matrix(queries.column("v").combine_chunks()), _matrix(candidates.column("v").combine_chunks())
        low, asked, taken, values = candidates.column("low").to_numpy(), [], [], []
        # what a query must at least reach to be of use
        floor = queries.column("floor").to_numpy() if "floor" in queries.column_names else np.full(len(qv), -np.inf)
        for i in range(0, len(qv) if len(cv) else 0, 256):
            for r, row in enumerate(qv[i : i + 256] @ cv.T, i):
                some = np.flatnonzero(row >= floor[r])
                if len(some) > k + 1:
                    part = row[some]
                    some = some[part >= np.partition(part, -k - 1)[-k - 1]]
                some = some[np.lexsort((low[some], -row[some]))][: k + 1]
                asked.append(np.full(len(some), r))
                taken.append(some)
                values.append(row[some])
        if not asked:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], ["q", "c", "score"])
        q, c = queries.column("point").take(pa.array(np.concatenate(asked), pa.int64())), candidates.column("point").take(pa.array(np.concatenate(taken), pa.int64()))
        return pa.table([q, c, pa.array(np.concatenate(values), pa.float64())], ["q", "c", "score"])

    return block


def search_orderings(pts: DataFrame, orderings: range, tops: dict[int, float], k: int, block: int) -> DataFrame:
    """(q, c, score) found along these orderings."""
    point = pts.schema["point"].dataType.simpleString()
    keyed = pts.select("point", "v", "dims", "norm2", "band", "is_query").mapInArrow(lambda b: _keys(b, orderings, tops), f"ordering int, band int, key long, point {point}, is_query boolean")
    order = ["ordering", "band", "key", "point", "is_query"]
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_rows.mapInArrow(_places, f"part int, at long, ordering int, point {point}, is_query boolean"), "curve")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    blocks = placed.join(offsets, "part").select("ordering", "point", "is_query", F.floor((F.col("offset") + F.col("at")) / block).cast("long").alias("block"))
    blocks = stored(blocks.join(pts.select("point", "v", F.col("point.low").alias("low")), "point"), "windows")
    near = F.expr("array(block - 1, block, block + 1)")
    # a query whose places in two bands share a block is compared once
    queries = blocks.filter("is_query").select("ordering", "point", "v", F.explode(near).alias("block")).dropDuplicates(["ordering", "block", "point"]).select("ordering", "block", "point", "v")
    candidates = blocks.filter("not is_query").select("ordering", "block", "point", "v", "low")
    queries, candidates = queries.toDF(*queries.columns), candidates.toDF(*candidates.columns)
    return queries.groupBy("ordering", "block").cogroup(candidates.groupBy("ordering", "block")).applyInArrow(_rerank(k), f"q {point}, c {point}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q, best): the k + 1 best points of each query, as (score, ids)."""
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= k + 1).drop("at")


def brute_force(pts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, c, score): the k + 1 best of all points for each of the few queries ``asked`` (bounded by SAMPLE)."""
    held = [(r["point"], np.array(r["v"], np.float64)) for r in asked.collect()]
    point = pts.schema["point"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for q, v in held:
                own = batch.filter(pa.array(dims == len(v), pa.bool_()))
                if not len(own):
                    continue
                scores = _matrix(own.column("v")) @ v
                some = np.argpartition(-scores, k)[: k + 1] if len(scores) > k + 1 else np.arange(len(scores))
                yield pa.record_batch([pa.array([q.asDict()] * len(some), own.column("point").type), own.column("point").take(pa.array(some, pa.int64())), pa.array(scores[some], pa.float64())], ["q", "c", "score"])

    return _best(pts.select("point", "v", "dims").mapInArrow(scan, f"q {point}, c {point}, score double"), k)


def exact_search(pts: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(q, c, score): of all points, those that belong before the last of a query's k + 1 best finds so far, or beside it.

    Queries and points meet in tiles, whose sides are bounded by ``EXACT_VALUES`` numbers. A query of fewer finds takes all.
    """
    point = pts.schema["point"].dataType.simpleString()
    sides = pts.agg(F.max("dims").alias("dims"), F.count(F.when(F.col("is_query"), 1)).alias("queries")).first()  # one row
    side = max(EXACT_LEAST, EXACT_VALUES // (sides["dims"] or 1))
    groups = max(1, -(-sides["queries"] // side))
    tiles = pts.groupBy("band").agg(F.max("norm2").alias("top"), F.ceil(F.count(F.lit(1)) / side).cast("int").alias("tiles"))
    bands = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("band", "top", "tiles")]) for r in tiles.collect()])  # a row per power of two: some 2,000 at most
    dealt = lambda n: F.pmod(F.xxhash64("point"), n).cast("int")
    last = best.groupBy("q").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    floor = F.when(F.col("found") > k, F.col("least") - F.abs("least") * ROUNDING)
    queries = pts.filter("is_query").drop("band").join(last, F.col("point") == F.col("q"), "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf"))))
    # the longest of a band gives no more than the product of lengths
    reached = F.filter(bands, lambda b: F.sqrt("norm2") * F.sqrt(b["top"]) * (1 + ROUNDING) >= F.col("floor"))
    queries = queries.select("*", F.inline(reached)).select("dims", "band", dealt(F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "point", "v", "floor")
    candidates = pts.join(F.broadcast(tiles.drop("top")), "band").select("dims", "band", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), dealt(F.col("tiles")).alias("tile"), "point", "v", F.col("point.low").alias("low"))
    by = ["dims", "band", "g", "tile"]
    return queries.groupBy(*by).cogroup(candidates.toDF(*candidates.columns).groupBy(*by)).applyInArrow(_rerank(k), f"q {point}, c {point}, score double")


def nearest(vectors: DataFrame, every: int, k: int = K, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, recall: float = RECALL, most: int = MOST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its ``k`` nearest of all other ids."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector)
    pts = stored(points(rows, every, k), "points")
    bands = pts.groupBy("band").agg(F.max("norm2").alias("top"), F.count(F.lit(1)).alias("n")).collect()  # a row per power of two: some 2,000 at most
    tops, n_points = {r["band"]: float(r["top"]) or 1.0 for r in bands}, sum(r["n"] for r in bands)
    sample = stored(pts.filter("is_query").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("point", "v"), "sample")
    truth = stored(brute_force(pts, sample, k), "truth")
    wanted = truth.count()
    best, done = None, 0
    while True:
        with small_batches(spark, 2000):
            new = search_orderings(pts, range(done, done + (MORE if done else ORDERINGS)), tops, k, block)
            best = stored(_best(new if best is None else new.unionByName(best), k), "best")
        done += MORE if done else ORDERINGS
        hit = best.join(truth.select("q", "c"), ["q", "c"], "left_semi").count()
        if hit >= recall * wanted:
            break
        if done >= most or done * 3 * block >= EXACT_AT * n_points:
            with small_batches(spark, 2000):
                best = stored(_best(exact_search(pts, best, k).unionByName(best), k), "best")
            break
    members = pts.select(F.col("point").alias("c"), "ids")
    each = best.join(members, "c").select("q", "score", F.explode("ids").alias("id"))
    each = each.groupBy("q", "id").agg(F.max("score").alias("score"))
    listed = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("all"))
    listed = listed.select("q", F.slice("all", 1, k + 1).alias("all"))
    asked = rows.filter(F.pmod(F.col("id"), F.lit(every)) == 0).distinct().select("id", "v")
    asked = asked.join(pts.filter("is_query").select(F.col("point").alias("q"), F.col("v").alias("w")), F.col("v") == F.col("w")).select("id", "q")
    out = asked.join(listed, "q").withColumn("own", F.slice(F.filter("all", lambda x: x["id"] != F.col("id")), 1, k))
    out = out.select(F.col("id").alias("query_id"), F.posexplode("own").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20)
