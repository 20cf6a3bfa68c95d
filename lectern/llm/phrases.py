"""Removal of repeated phrases of PHRASE words by Aho-Corasick automata.

Documents are cut into passages around anchors (see repeats.py); passages are dealt by anchor to shards, so that every
occurrence of a phrase comes to the shard that knows it.  Passages of the same words are one, the first of them (known by
128-bit BLAKE2b digests of their words); the others are repeats as a whole.  A shard confirms the windows that recur in it,
compiles them into one automaton over word numbers and streams its passages through it, which finds every occurrence of
each window and so its first one.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import repeats
from lectern.llm.suffix_dedup import small
from lectern.llm.words import word_hashes
from lectern.session import ship

PHRASE = 20
GRAM = 6
SHARD = 2_000  # passages of an automaton, at least
GROUP = 4_096  # passages around one anchor that go through one automaton, at most; more are split


class Words:
    """A text's words as units of repeats.py."""

    @staticmethod
    def hashes(texts: list[str | None]) -> list[np.ndarray]:
        hashes, _, _, at = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        return [hashes[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    @staticmethod
    def cutter(text: str | None):
        words = _words(text)
        joined, begins = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        return lambda start, stop: joined[begins[start] : begins[stop] - 1]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _passages(batches):
    for batch in small(batches):
        out: list[tuple] = []
        for row, text, contexts in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("contexts").to_pylist(), strict=True):
            words = _words(text)
            out += [(c["gram"], row, c["start"], b" ".join(words[c["start"] : c["start"] + c["n"] + PHRASE - 1])) for c in contexts]
        for at in range(0, len(out), 20_000):
            gram, row, start, passage = zip(*out[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(passage, pa.binary())], ["gram", "row", "start", "passage"])


def _locate(passages: list[tuple[int, int, bytes]]):
    """(row, start, stop) in words of stretches whose windows occur earlier in another of the passages (row, start, words)."""
    numbers: dict[bytes, int] = {}
    coded = [tuple(numbers.setdefault(w, len(numbers)) for w in p.split()) for _, _, p in passages]
    seen: set[tuple] = set()
    recurring: set[tuple] = set()
    for words in coded:
        for i in range(len(words) - PHRASE + 1):
            window = words[i : i + PHRASE]
            (recurring if window in seen else seen).add(window)
    if not recurring:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, window in enumerate(recurring):
        automaton.add_word(window, i)
    automaton.make_automaton()
    first: dict[int, tuple[int, int]] = {}
    found = []
    for (row, start, _), words in zip(passages, coded, strict=True):
        for end, i in automaton.iter(words):
            place = row, start + end - PHRASE + 1
            found.append((i, place))
            if i not in first or place < first[i]:
                first[i] = place
    for i, (row, at) in found:
        if first[i] < (row, at):
            yield row, at, at + PHRASE


def _scan(batches):
    held: list[tuple[int, int, bytes]] = []
    gram = None

    def located():
        rows = list(_locate(held))
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], ["row", "start", "stop"])

    for batch in batches:
        for g, row, start, passage in zip(*(batch.column(c).to_pylist() for c in ("gram", "row", "start", "passage")), strict=True):
            if g != gram and len(held) >= SHARD:
                yield located()
                held = []
            gram = g
            held.append((row, start, passage))
    yield located()


def _compare(texts: DataFrame, n: int) -> DataFrame:
    passages = texts.mapInArrow(_passages, "gram long, row long, start long, passage binary")
    return passages.repartition("gram").sortWithinPartitions("gram").mapInArrow(_scan, "row long, start long, stop long")


def _cut(batches):
    for batch in small(batches):
        out: list[tuple] = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = _words(text)
            gone = np.zeros(len(words) + 1, np.int32)
            for x in spans or ():
                gone[x["start"]] += 1
                gone[x["stop"]] -= 1
            covered = np.cumsum(gone)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
            kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c] if len(edge) else words
            out.append((len(words), len(words) - len(kept), [{"start": s, "stop": e} for s, e in edge.reshape(-1, 2).tolist()], b" ".join(kept).decode("utf-8", "replace")))
        n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "spans", "kept"],
        )


def remove_phrases(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row: its words without those inside a phrase that occurs earlier.

    Words are runs of characters other than space and \\t-\\r.  A window of 20 words is removed if the same words also start
    earlier: in a document of a smaller doc_id, or earlier in its own; the first occurrence stays.  A null text has no
    words; rows that repeat a doc_id come in order of text, a null doc_id before all; an empty table gives no rows.
    """
    ship(documents.sparkSession)
    rows = repeats.keyed(documents)
    spans = repeats.repeated_spans(rows, Words, PHRASE, GRAM, _compare, GROUP, first_stays=True)
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).hint("merge")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string"
    return rows.join(lists, "row", "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)
