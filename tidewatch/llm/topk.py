"""Exact top-k by inner product with MaxScore over integer vectors.

A dimension is a query term; a shard of vectors has, for each dimension, the products' upper bound.
For a query, the terms with the smallest bounds that together stay below the k-th score found so
far are non-essential: a vector that gains nothing from any other term can't be competitive and is
not looked at. The others collect their essential products, and the remaining terms are added,
largest bound first, only while a vector's sum plus what is left can still reach the k-th score.
Shards' results are merged by Spark.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.durable import BROADCAST_BYTES, bytes_of, durable

# Vectors of a shard and queries of a block.
SHARD, BLOCK = 4_096, 512
# Groups that shards are dealt to where the queries are too many for a broadcast.
GROUPS = 256
# Terms that are added between two looks at what is still competitive.
STRIDE = 8

_PACKED = "part string, dim int, ids binary, matrix binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v, dim) with v = floor(scale * x); vectors null, empty or with null or non-finite parts left out."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    picked = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return picked.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"), F.size("embedding").alias("dim"))


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Vectors of equal length as one row: ids, and the matrix with a line per dimension."""
    from pyspark import TaskContext

    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        dims = batch.column(2).to_numpy()
        ids = batch.column(0).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for i in range(0, len(at), most):
                some = at[i : i + most]
                matrix = batch.column(1).take(pa.array(some)).flatten().to_numpy().reshape(len(some), dim)
                row = [f"{part}-{count}", int(dim), ids[some].tobytes(), np.ascontiguousarray(matrix.T).tobytes()]
                count += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary()), pa.array([row[3]], pa.binary())], names=["part", "dim", "ids", "matrix"])


def search_shard(query: np.ndarray, own: int, lines: np.ndarray, ids: np.ndarray, k: int, floor_score: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the shard's best k for a query: those of at least ``floor_score``, the query's own id left out.

    Ties at the k-th score are kept by smaller id.
    """
    highs, lows = lines.max(axis=1), lines.min(axis=1)
    # What a term can add at most; never less than nothing, so that it also bounds vectors without gain.
    bounds = np.maximum(np.maximum(query * highs, query * lows), 0)
    order = np.argsort(-bounds, kind="stable")
    left = np.concatenate((np.cumsum(bounds[order][::-1])[::-1], [0]))
    alive = np.flatnonzero(ids != own)
    threshold = floor_score
    essential = len(order) if threshold is None else max(1, int(np.count_nonzero(left[:-1] >= threshold)))
    if threshold is not None and left[0] < threshold:
        return ids[:0], lines[0, :0]
    scores = np.zeros(lines.shape[1], np.int64)
    gains = np.zeros(lines.shape[1], bool)
    for d in order[:essential]:
        product = lines[d] * query[d]
        scores += product
        if threshold is not None:
            gains |= product > 0
    if threshold is not None and threshold > left[essential]:
        alive = alive[gains[alive]]
    sums = scores[alive]
    for i in range(essential, len(order), STRIDE):
        if threshold is not None:
            stays = sums + left[i] >= threshold
            alive, sums = alive[stays], sums[stays]
        some = order[i : i + STRIDE]
        sums = sums + query[some] @ lines[np.ix_(some, alive)]
    if threshold is not None:
        stays = sums >= threshold
        alive, sums = alive[stays], sums[stays]
    if len(sums) > k:
        least = np.partition(sums, len(sums) - k)[len(sums) - k]
        stays = sums >= least
        alive, sums = alive[stays], sums[stays]
    best = np.lexsort((ids[alive], -sums))[:k]
    return ids[alive][best], sums[best]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    # The k-th scores of the block searched last; a shard is met by all blocks in turn.
    kept: dict[str, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            ids, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
            lines = np.frombuffer(row["matrix"], np.int64).reshape(dim, -1)
            queries = np.frombuffer(row["queries"], np.int64).reshape(dim, -1).T
            if row["block"] not in kept and len(kept) >= 1_000:
                kept.clear()
            best = kept.setdefault(row["block"], np.full((len(asked), k), np.iinfo(np.int64).min))
            out: list[list[np.ndarray]] = [[], [], []]
            for q, (own, query) in enumerate(zip(asked, queries, strict=True)):
                known = int(best[q, 0])
                found, scores = search_shard(query, own, lines, ids, k, None if known == np.iinfo(np.int64).min else known)
                out[0].append(np.full(len(found), own))
                out[1].append(found)
                out[2].append(scores)
                best[q] = np.sort(np.concatenate((best[q], scores)))[-k:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by ``every`` its k best others.

    Score: inner product of floor(scale * x), ties to the smaller vec_id; all candidates where
    there are fewer. Vectors null, empty, without id, or with null or non-finite parts take no part,
    and only vectors of the query's length are candidates. Of rows that share a vec_id, all are
    candidates of others, none of each other, and the least vector asks. Components are expected
    below 2 ** 20, so that no sum leaves 64 bits.
    """
    ready = durable(integer_vectors(vectors, scale), "vectors")
    asking = ready.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.v", "q.dim")
    shards = durable(ready.select("vec_id", "v", "dim").mapInArrow(lambda batches: _pack(batches, SHARD), _PACKED), "shards")
    blocks = durable(asking.mapInArrow(lambda batches: _pack(batches, BLOCK), _PACKED), "blocks")
    blocks = blocks.select(F.col("part").alias("block"), "dim", F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    if bytes_of(blocks) <= BROADCAST_BYTES:
        pairs = shards.join(F.broadcast(blocks), "dim")
    else:
        # Each group of shards meets a copy of the queries.
        dealt = shards.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(GROUPS)))
        pairs = dealt.join(blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long")))), ["group", "dim"])
    found = pairs.select("dim", "ids", "matrix", "block", "query_ids", "queries").mapInArrow(lambda batches: _search(batches, k), _FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
