"""Which windows of W consecutive units (bytes, words) occur more than once, without a row for every window.

Each window has an anchor, the leftmost of its k-grams with the smallest hash, so equal windows have equal anchors at equal
places.  Windows that follow each other and share an anchor are a run (at most W - k + 1 windows); a run is known by its
anchor's hash (`gram`) and its content, the 128-bit BLAKE2b digest of all its units (`ctx_a`, `ctx_b`).  Then

- runs whose gram occurs once hold no repeated window, and are dropped by one count over all grams;
- runs of equal content repeat each other as a whole; of each content only the first occurrence goes on;
- where one gram stands in different contexts, the caller compares the contexts themselves, anchor by anchor;
- an anchor in more than `group` contexts is split by what stands around it: its windows are dealt to classes by their
  distance from the anchor, and the units that all windows of a class share are the key in place of the gram.  Classes are
  narrowed until no group is larger; one of a single distance shares whole windows, so that equal keys are equal contents.

Hashes of grams and keys only bring together what may be equal.  Grams that hold over a thousandth of all runs are joined
in SALTS parts, so that no key is one task's alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import workers
from lectern.llm.words import _power_arrays, mix
from lectern.session import materialize

NARROW = 8  # by how much a class of windows is narrowed at a time
SALTS = 32
RUN_SCHEMA = "row long, gram long, ctx_a long, ctx_b long, start int, n int, anchor int"
_RUN = ["row", "gram", "ctx_a", "ctx_b", "start", "n", "anchor"]
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF)


class Units(Protocol):
    """How a text is cut into units."""

    @staticmethod
    def hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
        """A 64-bit hash of every unit of every text."""

    @staticmethod
    def cutter(text: str | None) -> Callable[[int, int], bytes]:
        """The units from start to stop as bytes, equal only for equal units."""


def prefix_sums(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers from which span() hashes any stretch of the units."""
    power, inverse = _power_arrays(len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * power[:-1], out=total[1:])
    return total, inverse


def span(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))


def runs_of(units: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...] | None:
    """gram, start, n (windows), anchor (its place after start) of each run of one text's units."""
    if len(units) < window:
        return None
    total, inverse = prefix_sums(units)
    g = mix((total[k:] - total[:-k]) * inverse[: len(units) - k + 1])
    m = (g & _HIGH) | np.arange(len(g), dtype=np.uint64)
    w, l = window - k + 1, 1  # noqa: E741
    while 2 * l <= w:
        m = np.minimum(m[:-l], m[l:])
        l *= 2  # noqa: E741
    if l < w:
        m = np.minimum(m[: len(m) - (w - l)], m[w - l :])
    anchor = (m & _LOW).astype(np.int64)
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    stop = np.r_[start[1:], len(anchor)]
    return g[anchor[start]], start, stop - start, anchor[start] - start


def _parts(batches, size: int):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _emit_grams(units: Units, window: int, k: int):
    def run(batches):
        workers.begin("powers")
        for part in _parts(batches, 500):
            found = [r[0] for u in units.hashes(part.column("text").to_pylist()) if (r := runs_of(u, window, k))]
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return run


def _digests(cut: Callable[[int, int], bytes], starts: list[int], stops: list[int]) -> bytes:
    return b"".join([blake2b(cut(s, e), digest_size=16).digest() for s, e in zip(starts, stops, strict=True)])


def _batch(rows: list[np.ndarray], digests: list[bytes], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    gram, start, n, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    ctx = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    longs = (np.concatenate(rows), gram.view(np.int64), np.ascontiguousarray(ctx[:, 0]), np.ascontiguousarray(ctx[:, 1]))
    return pa.RecordBatch.from_arrays([*map(pa.array, longs), *(pa.array(x.astype(np.int32)) for x in (start, n, anchor))], _RUN)


def _emit_runs(units: Units, window: int, k: int):
    def run(batches):
        workers.begin("powers")
        for part in _parts(batches, 500):
            rows, digests, parts = [], [], []
            texts = part.column("text").to_pylist()
            for row, text, u in zip(part.column("row").to_pylist(), texts, units.hashes(texts), strict=True):
                if found := runs_of(u, window, k):
                    _, start, n, _ = found
                    digests.append(_digests(units.cutter(text), start.tolist(), (start + n + (window - 1)).tolist()))
                    rows.append(np.full(len(start), row))
                    parts.append(found)
            if parts:
                yield _batch(rows, digests, parts)

    return run


def keyed(documents: DataFrame, keep: tuple[str, ...] = (), nulls_last: bool = False) -> DataFrame:
    """(row, text, doc_id, *keep): row is doc_id where ids are unique; else rows are numbered in order of doc_id and text.

    Numbering is a range sort of the table; `row` then has the metadata `numbered`.
    """
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    odd = read.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return read.select(F.col("doc_id").alias("row"), "text", "doc_id", *keep)
    order = F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first()
    ordered = materialize(read.orderBy(order, "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    return ordered.select(F.col("row").alias("row", metadata={"numbered": True}), "text", "doc_id", *keep)


class Hot:
    """Keys that hold more than a thousandth of all rows, so at most a thousand; joins on them are dealt in SALTS parts."""

    def __init__(self, counts: DataFrame):
        """counts: (gram, n), written."""
        total = counts.agg(F.sum("n")).first()[0] or 0
        self.grams = [r.gram for r in counts.where(F.col("n") * 1000 > total).select("gram").collect()]

    def is_hot(self) -> Column:
        return F.col("gram").isin(self.grams) if self.grams else F.lit(False)

    def dealt(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("salt", F.when(self.is_hot(), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int"))

    def spread(self, rows: DataFrame) -> DataFrame:
        """The other side of a join with dealt() rows; as a merge join at every size, since it grows with the corpus."""
        every = F.array(*(F.lit(i) for i in range(SALTS)))
        return rows.withColumn("salt", F.explode(F.when(self.is_hot(), every).otherwise(F.array(F.lit(0))))).hint("merge")


def recurring_runs(rows: DataFrame, units: Units, window: int, k: int) -> tuple[DataFrame, Hot]:
    """Runs whose gram occurs more than once, written out, and the hot grams."""
    grams = rows.select("text").mapInArrow(_emit_grams(units, window, k), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    grams = materialize(grams, "grams")
    hot = Hot(grams)
    runs = hot.dealt(rows.select("row", "text").mapInArrow(_emit_runs(units, window, k), RUN_SCHEMA), "row", "start")
    return materialize(runs.join(hot.spread(grams.select("gram")), ["gram", "salt"], "left_semi").select(*_RUN), "runs"), hot


def first_contexts(runs: DataFrame) -> DataFrame:
    """One row for each content of each gram, written out: its first row and start, n, anchor and its count."""
    first = runs.groupBy("gram", "ctx_a", "ctx_b").agg(F.min(F.struct("row", "start", "n", "anchor")).alias("first"), F.count(F.lit(1)).alias("copies"))
    return materialize(first.select("gram", "ctx_a", "ctx_b", "first.*", "copies"), "contexts")


def mixed_contexts(contexts: DataFrame, hot: Hot, group: int) -> DataFrame:
    """Contexts whose gram stands in others too, written out, with `heavy`: it stands in more than `group`."""
    kinds = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    flagged = hot.spread(kinds.select("gram", (F.col("kinds") > group).alias("heavy")))
    return materialize(hot.dealt(contexts, "ctx_a").join(flagged, ["gram", "salt"]).select("row", "gram", "start", "n", "anchor", "heavy"), "mixed")


def with_text(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """The text of each row that has contexts, with the list of them; a merge join at every size, as the lists grow with the corpus."""
    lists = contexts.groupBy("row").agg(F.collect_list(F.struct("gram", "start", "n", "anchor")).alias("contexts"))
    return rows.select("row", "text").join(lists.hint("merge"), "row")


def _narrower(units: Units, window: int, k: int, width: int):
    """Each context in pieces of windows whose distances from the anchor are of one class, `width` distances wide."""
    last = window - k

    def run(batches):
        workers.begin("powers")
        for part in _parts(batches, 100):
            rows, digests, parts = [], [], []
            texts = part.column("text").to_pylist()
            for row, text, u, contexts in zip(part.column("row").to_pylist(), texts, units.hashes(texts), part.column("contexts").to_pylist(), strict=True):
                total, inverse = prefix_sums(u)
                at, low, high, number = [], [], [], []
                for c in contexts:
                    for j in range((c["anchor"] - c["n"] + 1) // width, c["anchor"] // width + 1):
                        at.append(c["start"] + c["anchor"])
                        low.append(max(c["anchor"] - c["n"] + 1, j * width))
                        high.append(min(c["anchor"], j * width + width - 1))
                        number.append(j)
                a, low, high, j = (np.array(x, np.int64) for x in (at, low, high, number))
                shared = span(total, inverse, a - j * width, a - np.minimum(j * width + width - 1, last) + window)
                start, n = a - high, high - low + 1
                digests.append(_digests(units.cutter(text), start.tolist(), (start + n + (window - 1)).tolist()))
                key = mix(shared + (j * window + width).astype(np.uint64)) if width > 1 else np.frombuffer(digests[-1], np.uint64)[::2]
                rows.append(np.full(len(a), row))
                parts.append((key, start, n, high))
            if parts:
                yield _batch(rows, digests, parts)

    return run


def repeated_spans(rows: DataFrame, units: Units, window: int, k: int, compare: Callable[[DataFrame, int], DataFrame], group: int, first_stays: bool) -> DataFrame:
    """(row, start, stop), in units, of stretches whose windows occur elsewhere too, or earlier too if the first one stays.

    `compare(texts, n)` gives the same for n contexts (row, text, contexts) with different contents around shared anchors,
    at most `group` of one anchor or key.
    """
    runs, hot = recurring_runs(rows, units, window, k)
    width, found = window - k + 1, []
    while True:
        contexts = first_contexts(runs)
        whole = hot.spread(contexts.where("copies > 1").select("gram", "ctx_a", "ctx_b", F.col("row").alias("first_row"), F.col("start").alias("first_start")))
        copies = hot.dealt(runs, "row", "start").join(whole, ["gram", "ctx_a", "ctx_b", "salt"])
        if first_stays:
            copies = copies.where("row <> first_row or start <> first_start")
        found.append(copies.select("row", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") + (window - 1)).cast("long").alias("stop")))
        mixed = mixed_contexts(contexts, hot, group)
        sizes = {r["heavy"]: r["count"] for r in mixed.groupBy("heavy").count().collect()}  # at most two rows
        if sizes.get(False):
            found.append(compare(with_text(rows, mixed.where("not heavy")), sizes[False]))
        if not sizes.get(True):
            break
        width = -(-width // NARROW)
        runs = materialize(with_text(rows, mixed.where("heavy")).mapInArrow(_narrower(units, window, k, width), RUN_SCHEMA), "runs")
        hot = Hot(materialize(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams"))
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans
