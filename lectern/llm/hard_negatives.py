"""Hard negatives: rows of another label that are nearly as like an anchor as its positives are.

Anchors and candidates are dealt into a grid, as in the top-k search.  A cell multiplies int64 tiles of anchors and candidates
by Strassen's recursion: odd dimensions get a line of zeros, seven products of halves and additions of integers give the four
quarters.  Sums wrap at 64 bits, which is exact for scores that fit; where a score might not, Python's integers are used.
The first pass keeps each anchor's positive heap, the second one heap for each anchor and positive, of the rows within the
positive's window.  Heaps of tiles are merged within a cell, heaps of shards as a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.topk import CELL_BYTES, FAN_IN, LONG
from lectern.session import materialize, ship

LEAF = 32
TILE = 1_024  # anchors and candidates of a tile
POSITIVES = "anchor_id long, positive_id long, score long, shard int"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, score long, shard int"


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Through floating-point numbers where they are exact, which is faster."""
    if a.size and b.size and float(max(abs(int(a.max())), abs(int(a.min())))) * float(max(abs(int(b.max())), abs(int(b.min())))) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64."""
    m, d, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, d, n) <= LEAF:
        return _leaf(a, b)
    a = np.pad(a, ((0, m % 2), (0, d % 2)))
    b = np.pad(b, ((0, d % 2), (0, n % 2)))
    h, k, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :k], a[:h, k:], a[h:, :k], a[h:, k:]
    b11, b12, b21, b22 = b[:k, :w], b[:k, w:], b[k:, :w], b[k:, w:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * h, 2 * w), np.int64)
    out[:h, :w], out[:h, w:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :w], out[h:, w:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, held within a long where they don't fit."""
    most = lambda x: max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    if most(a) * most(b) * max(1, a.shape[1]) < 2**63:
        return strassen(a, b.T)
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)


class Heap:
    """The k first of (score, id), by highest score and then smallest id; two of them merge into one."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Ids ascend and are larger than none held; equal scores keep that order."""
        if len(scores) > self.k:
            floor = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above = np.flatnonzero(scores > floor)
            at = np.concatenate([above, np.flatnonzero(scores == floor)[: self.k - len(above)]])
            scores, ids = scores[at], ids[at]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.ids.tolist(), self.scores.tolist(), strict=True)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest score s of low * score <= 100 * s <= high * score."""
    return max(-LONG, -(-low * score // 100)), min(LONG, high * score // 100)


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, list]


def _by_dimension(table: pa.Table, side: str = "", more: str | None = None) -> dict[int, Rows]:
    """ids, labels, matrix and further values by dimension, in order of ids; of rows that repeat an id the first by label, then vector."""
    if not table.num_rows:
        return {}
    ids, labels = (table.column(c).to_numpy() for c in (f"{side}id", f"{side}label"))
    column = pa.concat_arrays(table.column(f"{side}v").chunks)
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths(), np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    order = np.lexsort((labels, ids))
    group = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    first = order[group]
    for i in np.flatnonzero(np.diff(np.r_[group, len(order)]) > 1).tolist():
        same = order[group[i] : group[i + 1] if i + 1 < len(group) else None].tolist()
        first[i] = min(same, key=lambda r: (labels[r], flat[starts[r] : starts[r] + sizes[r]].tolist()))
    values = table.column(more) if more else None
    found = {}
    for d in np.unique(sizes[first]):
        own = first[sizes[first] == d]
        found[int(d)] = ids[own], labels[own], flat[(starts[own][:, None] + np.arange(d)).ravel()].reshape(len(own), d), [values[r].as_py() for r in own.tolist()] if more else [None] * len(own)
    return found


def _tiles(anchors: dict[int, Rows], candidates: dict[int, Rows]) -> Iterator[tuple]:
    """For each tile of anchors, by turns: its place, the anchors, a candidate tile's ids and labels, and the scores."""
    for d, (ids, labels, m, more) in anchors.items():
        if d not in candidates:
            continue
        c_ids, c_labels, c, _ = candidates[d]
        for at in range(0, len(ids), TILE):
            part = slice(at, at + TILE)
            yield ids[part], labels[part], more[part], ((c_ids[to : to + TILE], c_labels[to : to + TILE], products(m[part], c[to : to + TILE])) for to in range(0, len(c_ids), TILE))


def _shard(left: pa.Table) -> int:
    return left.column("shard")[0].as_py() if left.num_rows else 0


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, labels, _, tiles in _tiles(_by_dimension(right, "a_"), _by_dimension(left)):
            heaps = [Heap(k) for _ in ids]
            for c_ids, c_labels, scores in tiles:
                for i, heap in enumerate(heaps):
                    own = np.flatnonzero((c_labels == labels[i]) & (c_ids != ids[i]))
                    heap.push(scores[i, own], c_ids[own])
            out += [(a, i, s) for a, heap in zip(ids.tolist(), heaps, strict=True) for i, s in heap]
        a, i, s = zip(*out, strict=True) if out else ((), (), ())
        longs = [pa.array(x, pa.int64()) for x in (a, i, s)]
        return pa.table([*longs, pa.array([_shard(left)] * len(a), pa.int32())], ["anchor_id", "positive_id", "score", "shard"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, labels, positives, tiles in _tiles(_by_dimension(right, "a_", "positives"), _by_dimension(left)):
            heaps = [[(p["id"], p["score"], *window(p["score"], low, high), Heap(k)) for p in own] for own in positives]
            for c_ids, c_labels, scores in tiles:
                for i, own in enumerate(heaps):
                    others = np.flatnonzero((c_labels != labels[i]) & (c_ids != ids[i]))
                    row, of = scores[i, others], c_ids[others]
                    for _, _, least, most, heap in own:
                        within = np.flatnonzero((row >= least) & (row <= most))
                        if len(within):
                            heap.push(row[within], of[within])
            out += [(a, p, s, i, t) for a, own in zip(ids.tolist(), heaps, strict=True) for p, s, _, _, heap in own for i, t in heap]
        longs = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 5)]
        return pa.table([*longs, pa.array([_shard(left)] * len(out), pa.int32())], ["anchor_id", "positive_id", "positive_score", "negative_id", "score", "shard"])

    return run


def _merged(heaps: DataFrame, shards: int, by: tuple[str, ...], other: str, k: int) -> DataFrame:
    """The heaps of all shards as one, FAN_IN at a time, with the rank in it."""
    while True:
        w = Window.partitionBy(*by, "shard").orderBy(F.col("score").desc(), F.col(other))
        heaps = heaps.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        shards = math.ceil(shards / FAN_IN)
        if shards == 1:
            return heaps.drop("shard")


def labelled(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label long, v array<long>) of floor(scale * x); rows without id, label or vector, or with a component that is
    null or not finite, go; other columns are ignored."""
    rows = vectors.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    return whole.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard_rows: int = 32_768, anchor_rows: int = 8_192, least_shard_rows: int = 2_048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, v), as labelled() makes them.

    For each anchor and each of its first `positives` other rows of the same label, the first `negatives` rows of another label
    with low * positive_score <= 100 * negative_score <= high * positive_score; by highest inner product, ties to the smaller
    vec_id.  A window of a negative positive score is empty, that of 0 holds 0.  Rows that repeat a vec_id count as one, the
    first by label and vector; vectors of other dimensions are not compared; fewer rows than asked for give fewer; scores
    beyond 64 bits stay at the largest long.  Labels may be of any size, and no rows or no anchors give none.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = materialize(rows.select("vec_id", "label", "v", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "labelled")
    n, n_anchors, d = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    fitting = max(1, CELL_BYTES // (8 * max(1, d)))
    shard_rows, anchor_rows, least_shard_rows = min(shard_rows, fitting), min(anchor_rows, fitting), min(least_shard_rows, fitting)
    shards = max(1, math.ceil(n / shard_rows), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / least_shard_rows)))
    blocks = max(1, math.ceil(n_anchors / anchor_rows))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    number = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    dealt = rows.select(F.col("vec_id").alias("id"), "label", "v", number(shards).alias("shard"), every(blocks).alias("block")).groupBy("shard", "block")
    anchors = rows.where("is_anchor").select(*(F.col(c).alias(to) for c, to in (("vec_id", "a_id"), ("label", "a_label"), ("v", "a_v"))), number(blocks).alias("a_block"))
    asked = anchors.withColumn("a_shard", every(shards)).groupBy("a_shard", "a_block")
    found = _merged(dealt.cogroup(asked).applyInArrow(_positives(positives), POSITIVES), shards, ("anchor_id",), "positive_id", positives)
    found = materialize(found.select("anchor_id", "positive_id", "score"), "positives")
    held = found.groupBy(F.col("anchor_id").alias("a_id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("positives"))
    again = anchors.join(held, "a_id").withColumn("a_shard", every(shards)).groupBy("a_shard", "a_block")
    heaps = dealt.cogroup(again).applyInArrow(_negatives(negatives, low, high), NEGATIVES)
    best = _merged(heaps, shards, ("anchor_id", "positive_id", "positive_score"), "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
