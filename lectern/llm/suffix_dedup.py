"""Exact substring deduplication on bytes by a distributed merge sort of suffixes.

Only suffixes that can begin inside a repeated string are sorted: those at anchors (see repeats.py) that stand in several
contexts, one for each content.  Each task sorts its suffixes and front-codes the sorted run (length of the prefix shared
with the one before, and the rest); runs are exchanged by anchor, so that suffixes that share WINDOW bytes around an anchor
meet, and merged by a loser tree that carries common-prefix lengths and never compares a known prefix again.

The merged order decides what is repeated.  Suffixes are joined in order of falling common prefix, as in an LCP-interval
tree: when two sets meet at a prefix of L bytes, the nearest neighbours by what stands left of the anchor share M bytes
there, and all windows from W - L to M bytes before the anchor are in both.  The smaller set goes into the larger one, so
n suffixes take about n log n steps and no pairs.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import repeats, workers
from lectern.llm.words import _TABLE
from lectern.session import ship

WINDOW = 200
GRAM = 32
BUCKET = 8_000  # suffixes merged in one group, about
GROUP = 32_768  # suffixes at one anchor that are compared in one group, at most: about 12 MB; more are split
_BATCH = 10_000  # suffixes sorted in one run, at most


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Bytes:
    """A text's UTF-8 bytes as units of repeats.py."""

    @staticmethod
    def hashes(texts: list[str | None]) -> list[np.ndarray]:
        return [_TABLE[np.frombuffer(_bytes(t), np.uint8)] for t in texts]

    @staticmethod
    def cutter(text: str | None):
        data = _bytes(text)
        return lambda start, stop: data[start:stop]


def small(batches, rows: int = 300):
    """Batches of few rows, so that what is made of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    size = len(x)
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + size - (differ.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix with the string before, length of the rest, and all rests, of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = shared_prefix(before, s)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, np.int32), np.array([len(r) for r in rests], np.int32), b"".join(rests)


def decode(shared: np.ndarray, lengths: np.ndarray, rests: bytes):
    """(shared prefix with the one before, string) of a front-coded run."""
    before, at = b"", 0
    for n, l in zip(shared.tolist(), lengths.tolist(), strict=True):  # noqa: E741
        before = before[:n] + rests[at : at + l]
        at += l
        yield n, before


def merge(runs: list):
    """Merge sorted runs of (shared prefix with the one before, string): (shared prefix, string, run).

    Each entry of the tree carries its common prefix with the string last put out.  Of two entries the one with the longer
    such prefix is smaller, and the other keeps its own; only if they are equal are bytes compared, from there on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    done = (-1, None)
    heads = [next(r, done) for r in runs] + [done] * (k - len(runs))
    heads = [(0, s) if s is not None else done for _, s in heads]
    losers = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        (n, a), (m, b) = heads[i], heads[j]
        if b is None or a is not None and n > m:
            return i, j
        if a is None or m > n:
            return j, i
        h = shared_prefix(a, b, n)
        if h == len(a) or h < len(b) and a[h] < b[h]:
            heads[j] = (h, b)
            return i, j
        heads[i] = (h, a)
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        losers[node] = lose
        return win

    winner = build(1)
    while heads[winner][1] is not None:
        n, s = heads[winner]
        yield n, s, winner
        heads[winner] = next(runs[winner], done)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


# --- tasks --------------------------------------------------------------------------------------------------------

_RUN_FIELDS = ("shared", "lengths", "rests", "left_lengths", "lefts", "row", "at")


def _sorted_runs(buckets: int):
    def flush(held: list[tuple]):
        held.sort()
        by: dict[int, list[tuple]] = {}
        for x in held:
            by.setdefault(x[1], []).append(x)
        rows = []
        for bucket, own in sorted(by.items()):
            shared, lengths, rests = front_code([x[0] for x in own])
            numbers = [np.array([x[i] for x in own], np.int64).tobytes() for i in (3, 4)]
            rows.append((bucket, shared.tobytes(), lengths.tobytes(), rests, np.array([len(x[2]) for x in own], np.int32).tobytes(), b"".join(x[2] for x in own), *numbers))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", *_RUN_FIELDS])

    def run(batches):
        workers.begin("powers")
        held: list[tuple] = []
        for part in small(batches):
            for row, text, contexts in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), part.column("contexts").to_pylist(), strict=True):
                data = _bytes(text)
                for c in contexts:
                    s, a = c["start"], c["start"] + c["anchor"]
                    held.append((data[a : s + c["n"] - 1 + WINDOW], c["gram"] % buckets, data[s:a], row, a))
                if len(held) >= _BATCH:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def repeated_windows(prefixes: list[int], lefts: list[bytes], window: int):
    """(i, x, y) of sorted suffixes: windows that begin x to y bytes left of suffix i's anchor stand in another one too.

    prefixes[i] is the common prefix of suffixes i - 1 and i, lefts[i] the bytes before the anchor, reversed.
    """
    n = len(lefts)
    if n < 2:
        return
    if n == 2:
        both = shared_prefix(lefts[0], lefts[1])
        if both + prefixes[1] >= window:
            yield 0, window - prefixes[1], both
            yield 1, window - prefixes[1], both
        return
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    sets: dict[int, list[int]] = {i: [rank[i]] for i in range(n)}  # ranks by left side, sorted; of the set that ends or begins here
    begin, end = list(range(n)), list(range(n))
    for k in sorted(range(1, n), key=lambda k: -prefixes[k]):
        least = window - prefixes[k]
        first, last = begin[k - 1], end[k]
        large, few = sets.pop(first), sets.pop(k)
        if len(large) < len(few):
            large, few = few, large
        for r in few:
            at = bisect_left(large, r)
            best = -1
            for other in large[max(0, at - 1) : at + 1]:
                both = shared_prefix(lefts[order[r]], lefts[order[other]])
                if both >= least:
                    yield order[other], least, both
                best = max(best, both)
            if best >= least:
                yield order[r], least, best
            large.insert(at, r)
        sets[first] = large
        begin[last], end[first] = first, last


def _resolve(table: pa.Table) -> pa.Table:
    """Of one bucket's runs: (row, start, stop) of stretches of windows that occur in another context too."""
    columns = {f: table.column(f).to_pylist() for f in _RUN_FIELDS}
    runs, lefts, rows, places = [], [], [], []
    for i in range(table.num_rows):
        runs.append(decode(np.frombuffer(columns["shared"][i], np.int32), np.frombuffer(columns["lengths"][i], np.int32), columns["rests"][i]))
        ends = np.cumsum(np.r_[0, np.frombuffer(columns["left_lengths"][i], np.int32)]).tolist()
        lefts.append([columns["lefts"][i][s:e][::-1] for s, e in zip(ends[:-1], ends[1:], strict=True)])
        rows.append(np.frombuffer(columns["row"][i], np.int64).tolist())
        places.append(np.frombuffer(columns["at"][i], np.int64).tolist())
    taken = [0] * len(runs)
    found: list[tuple[int, int, int]] = []
    prefixes: list[int] = []
    group: list[tuple[int, int]] = []

    def close() -> None:
        stretches: dict[int, list[list[int]]] = {}
        for i, x, y in repeated_windows(prefixes, [lefts[r][p] for r, p in group], WINDOW):
            stretches.setdefault(i, []).append([x, y])
        for i, own in stretches.items():
            r, p = group[i]
            own.sort()
            x, y = own[0]
            for a, b in [*own[1:], (WINDOW * 2, 0)]:
                if a > y + 1:
                    found.append((rows[r][p], places[r][p] - y, places[r][p] - x + WINDOW))
                    x, y = a, b
                else:
                    y = max(y, b)

    for n, _, r in merge(runs):
        if n < GRAM and group:  # another gram
            close()
            prefixes, group = [], []
        prefixes.append(n)
        group.append((r, taken[r]))
        taken[r] += 1
    close()
    row, start, stop = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"row": pa.array(row, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})


def _compare(texts: DataFrame, n: int) -> DataFrame:
    buckets = max(8, math.ceil(n / BUCKET))
    schema = "bucket int, shared binary, lengths binary, rests binary, left_lengths binary, lefts binary, row binary, at binary"
    return texts.mapInArrow(_sorted_runs(buckets), schema).groupBy("bucket").applyInArrow(_resolve, "row long, start long, stop long")


def _cut(columns: list[str], whole_characters: bool):
    def run(batches):
        workers.begin("powers")
        for batch in small(batches):
            out: list[tuple] = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = _bytes(text)
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if whole_characters:
                        while s and data[s] & 0xC0 == 0x80:
                            s -= 1
                        while e < len(data) and data[e] & 0xC0 == 0x80:
                            e += 1
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                out.append((text is None, len(data), [{"start": s, "stop": e} for s, e in merged], b"".join(kept)))
            empty, sizes, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            made = [pa.array(empty, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], [*columns, "empty", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(documents: DataFrame, keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """(doc_id, *keep, empty, n_bytes, spans, kept) of every row: its UTF-8 bytes without those inside a repeated 200-byte string.

    Every occurrence goes, the first one too; `spans` are the maximal stretches removed, widened to whole characters if so
    asked; `empty` says that the text is null, which counts as an empty one.  Texts of fewer than 200 bytes keep all; whole
    texts count, however long.  Repeated rows are documents of their own and so repeat each other; a null doc_id is as
    good as any; an empty table gives no rows; columns beside doc_id, text and `keep` are ignored.
    """
    ship(documents.sparkSession)
    rows = repeats.keyed(documents, keep)
    spans = repeats.repeated_spans(rows, Bytes, WINDOW, GRAM, _compare, GROUP, first_stays=False)
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).hint("merge")
    columns, kinds = ["doc_id", *keep], dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", empty boolean, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    return rows.join(lists, "row", "left").select(*columns, "text", "spans").mapInArrow(_cut(columns, whole_characters), schema)
