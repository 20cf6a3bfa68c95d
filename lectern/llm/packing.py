"""Packing of documents into training sequences by cutting-stock column generation.

Each document's ids are cut into whole sequences and a tail; the tails are never cut.  Their length histogram, in classes
of CLASS_WIDTH tokens, is the demand of a cutting-stock problem.  Its linear program is solved by column generation
(knapsack dynamic programming prices new patterns), the patterns are rounded down, the rest is packed first-fit, and the
patterns are handed to the documents by their rank within a class.  Only the histogram and the patterns, whose sizes
depend on the classes alone, ever reach the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import workers
from lectern.session import materialize, ship

SEQUENCE = 4096
CLASS_WIDTH = 16
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Signs that part from letters; an apostrophe may not.
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
CACHED_WORDS = 1_000_000
GAP = 1e-3  # column generation stops when the program's bound is this close
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# --- tokens -------------------------------------------------------------------------------------------------------


class WordEncoder:
    """Text -> ids as little-endian bytes, by a tokenizers file that never joins text across spaces; words are kept.

    Texts of plain Latin letters are lower-cased first, which the tokenizer would do itself; all others go as they are.  Texts
    that hold one of the file's added tokens, such as an end mark written out, are encoded whole.
    """

    odd = re.compile("[^\x00-įı-ɏ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # what stands for one id whole, in whatever case: texts with it are encoded whole
        self.added = re.compile("|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    def _word(self, w: str) -> bytes:
        """Ids of one pre-token in lower-case letters of the Latin blocks, which the normalizer leaves as it is."""
        mapped = w if w.isascii() else self.bytes_of.pre_tokenize_str(w)[0][0]
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Letters with signs around them are three pre-tokens at most, each learned once; other chunks are encoded whole."""
        known, around, rest = self.known, [], set()
        for w in chunks:
            core = w.strip(SIGNS)
            if not core.isalpha() or not (core.islower() if core.isascii() else core == core.lower() and not self.odd.search(core)):
                rest.add(w)
                continue
            if core not in known:
                known[core] = self._word(core)
            if len(core) < len(w):
                head, _, tail = w.partition(core)
                if head and head not in known:
                    rest.add(head)
                if tail and tail not in known:
                    rest.add(tail)
                around.append((w, head, core, tail))
        for w, found in zip(rest, self.tokenizer.encode_batch(list(rest), add_special_tokens=False), strict=True):
            known[w] = array("I", found.ids).tobytes()
        known[""] = b""
        for w, head, core, tail in around:
            known[w] = known[head] + known[core] + known[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        get, out, new = self.known.get, [], set()
        for t in texts:
            low = t.lower() if t else ""
            if self.added.search(low):
                out.append(([array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()], []))
                continue
            words = (t if self.odd.search(t) else low).replace("\n", " ").split(" ") if t else []
            found = list(map(get, words))
            missing = [(i, words[i]) for i, f in enumerate(found) if f is None] if None in found else []
            new.update(w for _, w in missing)
            out.append((found, missing))
        self._learn(new)
        for found, missing in out:
            for i, w in missing:
                found[i] = self.known[w]
        return [b"".join(found) for found, _ in out]


_encoders: dict[str, WordEncoder] = {}
workers.keeps("encoders", _encoders.clear)


def _cut(path: str, end_id: int, sequence: int):
    def run(batches):
        workers.begin("encoders")
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder, end = _encoders[path], np.uint32(end_id).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, sequence):
                        piece = ids[4 * start : 4 * (start + sequence)]
                        for column, x in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def cut_documents(documents: DataFrame, path: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole sequences of each document, and its tail."""
    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_cut(path, end_id, sequence), PIECE_SCHEMA)


# --- the cutting-stock problem, in units of the class width ---------------------------------------------------------


def _price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack over item sizes 1..len(duals)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    m = len(duals)
    for w in range(1, capacity + 1):
        k = min(w, m)
        values = duals[:k] + best[w - 1 :: -1][:k] if w > k else duals[:k] + best[w - k : w][::-1]
        i = int(values.argmax())
        if values[i] > best[w - 1]:
            best[w], choice[w] = values[i], i + 1
        else:
            best[w] = best[w - 1]
    pattern, w = np.zeros(m, int), capacity
    while w > 0:
        if choice[w]:
            pattern[choice[w] - 1] += 1
            w -= choice[w]
        else:
            w -= 1
    return float(best[capacity]), pattern


def patterns_for(demand: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """(copies, {size: items}) of patterns that hold the whole demand exactly; sizes 1..capacity, in units."""
    sizes = sorted(s for s, n in demand.items() if n)
    if not sizes:
        return []
    m, need = len(sizes), np.array([demand[s] for s in sizes], float)
    columns = [np.eye(m, dtype=int)[i] * (capacity // s) for i, s in enumerate(sizes)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    amounts = inverse @ need
    for _ in range(20 * m):
        duals = np.maximum(inverse.sum(axis=0), 0)
        by_size = np.full(capacity, -1.0)
        by_size[np.array(sizes) - 1] = duals
        value, found = _price(by_size, capacity)
        if value <= 1 + gap:
            break
        column = found[np.array(sizes) - 1]
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        step = ratios[out]
        amounts -= step * direction
        amounts[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[out] = column
    left = need.astype(int)
    rounded: Counter = Counter()
    for column, x in sorted(zip(columns, amounts, strict=True), key=lambda p: -p[1]):
        used = column > 0
        copies = min(int(x + 1e-9), int((left[used] // column[used]).min()) if used.any() else 0)
        if copies > 0:
            rounded[tuple((sizes[i], int(column[i])) for i in np.flatnonzero(used))] += copies
            left -= copies * column
    # the rest, at most a pattern's worth of each class: best fit, longest first
    bins: list[tuple[int, Counter]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(m - 1, -1, -1):
        for _ in range(left[i]):
            free = next((r for r in range(sizes[i], capacity + 1) if room[r]), None)
            if free is None:
                bins.append((0, Counter()))
                at, free = len(bins) - 1, capacity
            else:
                at = room[free].pop()
            bins[at][1][sizes[i]] += 1
            room[free - sizes[i]].append(at)
    for _, items in bins:
        rounded[tuple(sorted(items.items()))] += 1
    return [(copies, dict(items)) for items, copies in sorted(rounded.items())]


def slots_of(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each size, rows (first rank, first sequence, items a sequence, first slot) in order of rank."""
    found: dict[int, list] = {}
    given: Counter = Counter()
    base = 0
    for copies, items in patterns:
        slot = 0
        for s, n in sorted(items.items(), reverse=True):
            found.setdefault(s, []).append((given[s], base, n, slot))
            given[s] += copies * n
            slot += n
        base += copies
    return {s: np.array(rows, np.int64) for s, rows in found.items()}


def _place(slots: dict[int, np.ndarray]):
    def run(batches):
        workers.begin()
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                here = size == s
                table = slots[int(s)]
                row = table[np.searchsorted(table[:, 0], rank[here], side="right") - 1]
                within = rank[here] - row[:, 0]
                sequence[here], slot[here] = row[:, 1] + within // row[:, 2], row[:, 3] + within % row[:, 2]
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    return run


def pack(pieces: DataFrame, sequence: int = SEQUENCE, width: int = CLASS_WIDTH, salt_rows: int = 20_000) -> DataFrame:
    """pieces (at most `sequence` tokens long each) with sequence_id and offset.

    Sequence ids run from 0 without gaps; a sequence's pieces are adjacent from offset 0.  Every piece, repeated ones and
    those of a null doc_id too, gets a place of its own; no pieces give no rows.  Ranks within a class are counted by
    salt, so that a class that holds a third of all pieces is no task's alone.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    sized = pieces.select(*columns, F.ceil(F.col("length") / width).cast("long").alias("size"))
    demand = {r["size"]: r["count"] for r in sized.groupBy("size").count().collect()}  # at most sequence / width rows
    slots = slots_of(patterns_for(demand, sequence // width))
    salts = max(64, -(-sum(demand.values()) // salt_rows))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("size", "salt").count()
    before = counts.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("size", "salt").orderBy(*columns)))
    placed = ranked.join(before, ["size", "salt"]).select(*columns, "size", (F.col("before") + F.col("within") - 1).alias("rank")).mapInArrow(_place(slots), PIECE_SCHEMA + ", sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")


def pack_documents(documents: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Cut and pack: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A null or empty text has the end id alone; whole texts count, however long, in pieces of at most `sequence` ids.
    Repeated rows, and those without doc_id, are packed each; pieces of one size are ranked by all their columns, so equal
    ones may change places without a difference; no documents give no rows; columns beside doc_id and text are ignored.
    """
    return pack(materialize(cut_documents(documents, path, sequence=sequence), "pieces"), sequence)
