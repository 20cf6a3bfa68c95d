"""Words that differ by one inserted, deleted or replaced code point, and the form that a variant stands for.

Two words, the longer of b code points, are one edit apart if their common prefix and their common suffix reach b - 1
together.  Then one of the two reaches b // 2, so words meet in tiles: those of b or b - 1 code points that share their first
b // 2, and those that share their last b // 2.  A tile holds its words as matrices of code points, padded to the tile's width
on the right for prefixes and on the left for suffixes, and compares them densely, block against block.  A pair that both kinds of tile
would find counts in the first kind only.  Tiles emit sums for each word, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.lines import fold
from lectern.operators.skew import join_by_weight
from lectern.session import materialize, ship

RUN = "[A-Za-zÀ-ÿ]+"
BLOCK = 2_048  # words of a block
BLOCK_CELLS = 4_000_000  # code points of a block
TILE_CELLS = 1_000_000  # pairs compared at a time
PACKED = 64  # words of small groups that share a tile
SUMS = "word string, n long, n_near long, near_n long, near string"


def spoilt(doc_id: Column, run: Column, every: int) -> Column:
    """A run in small letters; where `every` divides the CRC-32 of `<doc_id>:<run>`, without its code point at that number."""
    low = fold(run)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low))
    at = (h % F.char_length(low)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.char_length(low)))).otherwise(low)


def words_of(documents: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the distinct words of all texts, spoilt as above, of at least so many code points and occurrences.

    A null text has none; a null doc_id is empty in front of the colon; rows count as they are, repeated ones again.
    """
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= shortest)
    made = runs.select(spoilt(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.char_length("word") >= shortest)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points of the words, padded by zeros on the right, or on the left if they stand at the right edge."""
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, width - len(points) :] = points if right else 0
        if not right:
            out[i, : len(points)] = points
    return out


def common(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many columns in a row, from the first, are equal in each pair of rows, and which pairs have `least` at all."""
    run = np.ones((len(a), len(b)), bool)
    n = np.zeros((len(a), len(b)), np.int32)
    alive = run
    for j in range(a.shape[1]):
        run &= a[:, j, None] == b[None, :, j]
        n += run
        if j + 1 == least:
            alive = run.copy()
        if not run.any():
            break
    return n, alive if least else np.ones_like(run)


class Tile:
    """Words of b and b - 1 code points: how many near words each has, and the best of them (largest n, then smallest word)."""

    def __init__(self, words: list[str], n: np.ndarray, b: int, by_suffix: bool):
        self.words, self.n, self.b, self.by_suffix = words, n, b, by_suffix
        self.order = sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words), np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.left, self.right = (matrix(words, b, right) for right in (False, True))

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Words at places `left` with words at places `right`; each pair is given once."""
        step = max(1, TILE_CELLS // max(1, len(right)))
        for at in range(0, len(left), step):
            self._block(left[at : at + step], right)

    def within(self, places: np.ndarray) -> None:
        """All pairs of these words, longer ones on the left: equal lengths block by block above the diagonal."""
        long, short = places[self.sizes[places] == self.b], places[self.sizes[places] == self.b - 1]
        if len(long) and len(short):
            self.compare(long, short)
        step = 512
        for at in range(0, len(long), step):
            own = long[at : at + step]
            if len(own) > 1:
                self._block(own, own, above=True)
            if at + step < len(long):
                self.compare(own, long[at + step :])

    def across(self, one: np.ndarray, other: np.ndarray) -> None:
        for x, y in ((one, other), (other, one)):
            long = x[self.sizes[x] == self.b]
            rest = y if x is one else y[self.sizes[y] == self.b - 1]
            if len(long) and len(rest):
                self.compare(long, rest)

    def _block(self, left: np.ndarray, right: np.ndarray, above: bool = False) -> None:
        half = self.b // 2
        prefix, meets = common(self.left[left], self.left[right], half)
        if not self.by_suffix and not meets.any():
            return
        suffix, _ = common(self.right[left][:, ::-1], self.right[right][:, ::-1], 0)
        found = (prefix + suffix >= self.b - 1) & (prefix < self.b) & ((prefix < half) if self.by_suffix else meets)
        if above:
            found &= np.tri(len(left), dtype=bool).T & ~np.eye(len(left), dtype=bool)
        x, y = np.nonzero(found)
        if len(x):
            x, y = left[x], right[y]
            for own, other in ((x, y), (y, x)):
                np.add.at(self.near, own, 1)
                np.minimum.at(self.best, own, self.rank[other])

    def sums(self) -> Iterator[tuple]:
        for i in np.flatnonzero(self.near).tolist():
            best = self.order[int(self.best[i])]
            yield self.words[i], int(self.n[i]), int(self.near[i]), int(self.n[best]), self.words[best]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of tile; groups of one block are packed together, as pairs of different groups never count."""
    out: list[tuple] = []

    def done(held: list[tuple]) -> None:
        b, by_suffix, i, j = held[0][:4]
        tile = Tile([r[6] for r in held], np.array([r[7] for r in held], np.int64), b, bool(by_suffix))
        block = np.array([r[5] for r in held], np.int64)
        if i == j:
            tile.within(np.arange(len(held)))
        else:
            tile.across(np.flatnonzero(block == i), np.flatnonzero(block == j))
        out.extend(tile.sums())

    def flush() -> pa.RecordBatch:
        words, n, near, near_n, best = zip(*out, strict=True) if out else ((),) * 5
        out.clear()
        longs = [pa.array(x, pa.int64()) for x in (n, near, near_n)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *longs, pa.array(best, pa.string())], ["word", "n", "n_near", "near_n", "near"])

    held: list[tuple] = []
    last: tuple | None = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("b", "by_suffix", "i", "j", "key", "block", "word", "n", "blocks")), strict=True):
            at, packs = (*row[:5], row[8]), row[8] == 1
            if held and at != last and not (packs and last[5] == 1 and at[:2] == last[:2] and len(held) < PACKED and len(held) * row[0] < TILE_CELLS):
                done(held)
                held = []
                if len(out) >= 10_000:
                    yield flush()
            held.append(row)
            last = at
    if held:
        done(held)
    yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near_n, near) of every row of (word, n), a written table of distinct words: the number of words one
    edit away, and the one of them with the largest n (ties: the smallest word)."""
    ship(words.sparkSession)
    b, half = F.col("b"), F.floor(F.col("b") / 2).cast("int")
    length = F.char_length("word")
    wide = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("b"))
    both = wide.select("word", "n", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("by_suffix"))
    shared = F.when(F.col("by_suffix") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", length - half + 1, half))
    spread = both.select("word", "n", "b", "by_suffix", F.xxhash64("by_suffix", "b", shared).alias("key"))
    groups = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("b").alias("most"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("m") * F.col("most") / BLOCK_CELLS)).cast("int")
    sized = materialize(groups.where("m > 1").select("key", "m", blocks.alias("blocks")), "groups")
    dealt = join_by_weight(spread, sized, "key", "m").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("b", "by_suffix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "word", "n", "blocks")
    tiles = cells.repartition("key", "i", "j").sortWithinPartitions("by_suffix", "b", "key", "i", "j")
    sums = tiles.mapInArrow(_tiles, SUMS)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    found = own.unionByName(sums).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form), distinct words without circles: the end of its chain.

    Every round doubles the steps taken, so the rounds are the logarithm of the longest chain; each is written to the shared
    folder, and words at their end wait aside.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    ends = now.limit(0)
    while now.limit(1).count():
        beyond = now.unionByName(ends).select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = materialize(now.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(beyond, "root", "left"), "ahead")
        stepped = materialize(join_by_weight(now, ahead, "root", "n").select("word", "root", "beyond"), "stepped")
        ends = ends.unionByName(stepped.where("beyond is null").select("word", "root"))
        now = stepped.where("beyond is not null").select("word", F.col("beyond").alias("root"))
    return ends


def group_variants(documents: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of words_of(): its form is the near word of largest n, if that n is
    at least `ratio` times the word's (2 or more, so that chains end); its root the end of the chain of forms, or the word.

    Null and empty texts have no words, a null doc_id reads as empty; repeated rows count again; words and texts may be of any
    length; ties between near words go to the smallest word in code-point order; an empty table gives no rows; columns
    other than doc_id and text are ignored, whatever their names.
    """
    words = materialize(words_of(documents.select("doc_id", "text"), every, shortest, least), "words")
    has = F.col("near_n") >= ratio * F.col("n")
    found = materialize(near_words(words).select("word", F.when(has, F.col("near")).alias("form"), "n", "n_near", F.when(has, F.col("near_n")).alias("form_n")), "near")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
