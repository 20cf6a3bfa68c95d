"""Exact top-k inner-product search.

Queries and candidates are dealt into a grid: candidate shards of at most `shard_rows` vectors, query blocks of at most
`query_rows`, and fewer of long vectors, so that neither matrix is larger than CELL_BYTES.  Both sides of a cell are as large
as they may be, since a candidate travels once for each block and a query once for each shard.  Each cell multiplies its two matrices tile by tile and keeps the k best of each query; the lists of the
shards are then merged as a tree, `FAN_IN` lists at a time, so that no task sees more than FAN_IN * k rows of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import ship

FAN_IN = 16
TILE_CELLS = 2_000_000
CELL_BYTES = 64_000_000  # of a matrix of longs in a cell; products take float copies of it
LONG = 2**63 - 1
TILE_SCHEMA = "query_id long, vec_id long, score long, shard int"


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x), x as double.

    Rows without id or vector, or with a component that is null or not finite, go; an empty vector is one of dimension 0;
    repeated rows stay; columns beside vec_id and embedding are ignored.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (
        vectors.select("vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    )


def _matrices(table: pa.Table, key: str, vector: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix for each dimension, in order of ids."""
    ids = table.column(key).to_numpy()
    column = table.column(vector).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, np.asarray(column.value_lengths())])
    found = {}
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        found[int(d)] = ids[rows], flat[(ends[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
    return found


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 2**53 in Python's integers, held within a long."""
    if q.shape[1] and float(np.abs(q.astype(float)).max()) * float(np.abs(m.astype(float)).max()) * q.shape[1] >= 2**53:
        exact = q.astype(object) @ m.astype(object).T
        return np.clip(exact, -LONG, LONG).astype(np.int64)
    return (q.astype(float) @ m.astype(float).T).astype(np.int64)


def best_of_tile(q_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """Rows (query, id, score) of the k best of each query; ids ascend and are distinct; a query's own id is left out."""
    for i, row in enumerate(scores):
        mine = np.flatnonzero(ids != q_ids[i])
        own = row[mine]
        if len(own) > k:
            floor = np.partition(own, len(own) - k)[len(own) - k]
            above = np.flatnonzero(own > floor)
            mine = mine[np.concatenate([above, np.flatnonzero(own == floor)[: k - len(above)]])]
        yield q_ids[i], ids[mine], row[mine]


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        candidates = _matrices(left, "vec_id", "v") if left.num_rows else {}
        for d, (q_ids, q) in (_matrices(right, "query_id", "q") if right.num_rows else {}).items():
            if d not in candidates:
                continue
            ids, m = candidates[d]
            distinct, first = np.unique(ids, return_index=True)
            step = max(1, TILE_CELLS // max(1, len(ids)))
            for at in range(0, len(q_ids), step):
                scores = _products(q[at : at + step], m)
                if len(distinct) < len(ids):  # rows that repeat an id count once, with their best score
                    scores = np.maximum.reduceat(scores, first, axis=1)
                out += [(np.full(len(x), i), x, s) for i, x, s in best_of_tile(q_ids[at : at + step], scores, distinct, k)]
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64()), "shard": pa.array([shard] * len(a), pa.int32())})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, shard_rows: int = 65_536, query_rows: int = 65_536, least_shard_rows: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by inner product, ties to the smaller vec_id.

    Both inputs are (vec_id long, v array<long>), as quantise() makes them.  A candidate with the query's own id is
    never its result; candidates of another dimension than the query's are not compared; rows that repeat a vec_id count
    as one, with the best of their scores; fewer than k candidates give fewer rows; no queries or no candidates, none.
    Scores beyond 64 bits stay at the largest long.  Vectors may be of any length; other columns are ignored.
    """
    spark = candidates.sparkSession
    ship(spark)
    sizes = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first() for df in (candidates, queries)]
    (n, _), (n_queries, _) = sizes
    fitting = max(1, CELL_BYTES // (8 * max(1, *(d for _, d in sizes))))
    shard_rows, query_rows, least_shard_rows = min(shard_rows, fitting), min(query_rows, fitting), min(least_shard_rows, fitting)
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / shard_rows), min(2 * cores, math.ceil(n / least_shard_rows)))
    blocks = max(1, math.ceil(n_queries / query_rows))
    dealt = candidates.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("q_shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("q_block"))
    lists = dealt.groupBy("shard", "block").cogroup(asked.groupBy("q_shard", "q_block")).applyInArrow(_cell(k), TILE_SCHEMA)
    best = [F.col("score").desc(), F.col("vec_id")]
    while True:
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard"), "vec_id").agg(F.max("score").alias("score"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k)
        shards = math.ceil(shards / FAN_IN)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
