"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import BATCH_ROWS, output, scan, stored_map

#: Rows of a tile of candidates and of a block of queries, and the shards that tiles are dealt to.
TILE_ROWS, BLOCK_ROWS, SHARDS = 4096, 512, 48
#: Sums of products below this are whole numbers in a double.
EXACT = 2.0**53
TILE = "tile long, dim int, ids binary, kind string, data binary"


def _packed(batches: Iterator[pa.RecordBatch], scale: float, rows: int) -> Iterator[pa.RecordBatch]:
    """Tiles of whole-number vectors of one length, ids ascending inside a tile."""
    part, number = TaskContext.get().partitionId(), 0
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def tile(dim: int) -> pa.RecordBatch:
        nonlocal number
        ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        order = np.argsort(ids, kind="stable")
        ids, data = ids[order], data[order]
        kind = "<f4" if np.array_equal(data.astype("<f4"), data) else "<f8"
        row = {"tile": ([part << 32 | number], pa.int64()), "dim": ([dim], pa.int32()), "ids": ([ids.tobytes()], pa.binary()), "kind": ([kind], pa.string()), "data": ([data.astype(kind).tobytes()], pa.binary())}
        number += 1
        return output(row)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = batch.column(1)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begins = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist():
            rows_of = np.flatnonzero(sizes == dim)
            data = np.floor(scale * flat[begins[rows_of][:, None] + np.arange(dim)])
            held.setdefault(dim, []).append((ids[rows_of], data))
            if sum(len(i) for i, _ in held[dim]) >= rows:
                yield tile(dim)
    for dim in list(held):
        yield tile(dim)


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row, ties to the smaller column; -inf takes no part."""
    k = min(k, scores.shape[1])
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above = scores > least
    level = (scores == least) & np.isfinite(scores)
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)


def _products(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, asks = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
            tile = np.frombuffer(row["data"], row["kind"]).astype(np.float64).reshape(len(ids), -1)
            block = np.frombuffer(row["q_data"], row["q_kind"]).astype(np.float64).reshape(len(asks), -1)
            if np.abs(tile).max(initial=0) * np.abs(block).max(initial=0) * row["dim"] < EXACT:
                scores = block @ tile.T
                own = asks[:, None] == ids[None, :]
                scores[own] = -np.inf
                q, c = _top(scores, k)
                values = scores[q, c].astype(np.int64)
            else:
                q, c, values = _large(block, tile, asks, ids, k)
            yield output({"query_id": (asks[q], pa.int64()), "shard": ([row["shard"]] * len(q), pa.int32()), "vec_id": (ids[c], pa.int64()), "score": (values, pa.int64())})


def _large(block: np.ndarray, tile: np.ndarray, asks: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """The same in whole numbers of any size; scores beyond a long are held at its ends."""
    columns = [[int(x) for x in row] for row in tile]
    q, c, values = [], [], []
    for i, ask in enumerate(block):
        whole = [int(x) for x in ask]
        scores = [(-max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, whole, column)))), j) for j, column in enumerate(columns) if ids[j] != asks[i]]
        for score, j in sorted(scores)[:k]:
            q.append(i)
            c.append(j)
            values.append(-score)
    return q, c, values


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x) with all other vectors.

    vectors and queries have vec_id and embedding; rows of the query's own vec_id are no candidates. Candidates are
    packed into tiles dealt over shards, queries into blocks; each shard's tiles are multiplied with every block, a
    partial selection keeps k of a tile, and lists are merged by shard, then by query. Memory of a task: a tile, a
    block and their product.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do null ids; lengths that
    differ never meet. Of queries that repeat a vec_id the smallest vector asks; repeated candidates count each. Ties go to the
    smaller vec_id; fewer candidates give fewer rows; empty tables give none. Further columns are not read.
    """
    finite = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    usable = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null").where(finite)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).repartition("vec_id")
    tiles = stored_map(usable(vectors), partial(_packed, scale=scale, rows=TILE_ROWS), TILE, BATCH_ROWS, "tiles")
    blocks = stored_map(asked, partial(_packed, scale=scale, rows=BLOCK_ROWS), TILE, BATCH_ROWS, "query-blocks")
    dealt = tiles.withColumn("shard", F.pmod(F.xxhash64("tile"), F.lit(SHARDS)).cast("int"))
    asks = blocks.select("dim", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data"))
    asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
    pairs = dealt.join(asks, ["shard", "dim"])
    partly = stored_map(pairs, partial(_products, k=k), "query_id long, shard int, vec_id long, score long", 8, "tile-tops")
    best = [F.col("score").desc(), F.col("vec_id")]
    for keys in (["query_id", "shard"], ["query_id"]):
        partly = partly.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return partly.select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark, sf_dir):
    vectors = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


#: The same in SQL.
OP2_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""
