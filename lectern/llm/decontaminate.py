"""Benchmark decontamination: a prefix-filtered containment join of benchmark windows with documents, in built-in functions.

A window is WINDOW consecutive words of an item (all words of a shorter one).  Its shingles of three words are ordered by
how often they occur in the documents; the rarest is its necessary prefix, since a document that contains the window
contains that shingle.  One scan of the documents counts their words and finds all places of shingles that stand in any
window; rarity and the join on prefixes work on these places.  Of a match the length and position bounds are tested first
and then, on the texts of the documents that are left, the window's words, exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.language import let
from lectern.llm.repeats import keyed
from lectern.session import materialize

WINDOW = 13
SHINGLE = 3
#: Rows of shingles, prefixes or candidates that are broadcast at most (about 50 MB); beyond, these joins shuffle.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words as they stand; A-Z are lower-cased where exactness matters, by fold()."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _shingle(words: Column, at: Column, n: int) -> Column:
    """A hash of words, the same for words that fold() makes equal, each lower-cased alone; the window test decides."""
    return F.xxhash64(*(F.lower(F.get(words, at + i)) for i in range(n)))


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, text, length, shingles array<struct<h, offset>>): the distinct windows of each item."""
    words = benchmark.select("item_id", F.split(fold(F.array_join(words_of(F.col("text")), " ")), " ").alias("w")).where(F.element_at("w", 1) != "")
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - length)
    cut = words.select("item_id", length.alias("length"), F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, length))).alias("v"))
    at_once = F.least(F.col("length"), F.lit(SHINGLE))
    of = lambda i: reduce(lambda e, n: F.when(at_once == n, _shingle(F.col("v"), i, n)).otherwise(e), range(1, SHINGLE), _shingle(F.col("v"), i, SHINGLE))
    spread = F.transform(F.sequence(F.lit(0), F.col("length") - at_once), lambda i: F.struct(of(i).alias("h"), i.alias("offset")))
    return cut.select("item_id", F.array_join("v", " ").alias("window"), "length", spread.alias("shingles")).distinct()


def places(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, doc_id, n_words, pos, h): where shingles of windows stand in the documents, and one row of null h for each document."""
    wanted = _bounded(materialize(windows.select(F.explode("shingles.h").alias("h")).distinct(), "shingles"))
    read = rows.select("row", "doc_id", words_of(F.col("text")).alias("w")).select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w")
    spread = read.select("row", "doc_id", "n_words", "w", F.posexplode_outer("w").alias("pos", "word"))
    hashes = [_shingle(F.col("w"), F.col("pos"), n) for n in sizes]
    each = spread.select("row", "doc_id", "n_words", "pos", F.explode(F.array(*hashes)).alias("h") if len(sizes) > 1 else hashes[0].alias("h"))
    found = each.join(wanted.select("h", F.lit(True).alias("in_window")), "h", "left")
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    kept = found.select("row", "doc_id", "n_words", "pos", F.when(F.col("in_window"), F.col("h")).alias("h"), first.alias("first")).where("first or h is not null")
    return materialize(kept.drop("first"), "places")


def prefixes(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, item_id, window, length, h, offset, other_h, other_offset), written, of each window that may stand somewhere.

    h is the shingle that is rarest in the documents, other_h the rarest one that has no word in common with it (null for
    short windows); a window with a shingle that stands nowhere stands nowhere.
    """
    spread = windows.select("item_id", "window", "length", F.explode("shingles").alias("s")).select("item_id", "window", "length", "s.h", "s.offset")
    counts = found.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarity = spread.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lists = rarity.groupBy("item_id", "window", "length").agg(F.array_sort(F.collect_list(F.struct("n", "h", "offset"))).alias("by_rarity"))  # at most a window's shingles
    first = F.get("by_rarity", 0)
    other = F.get(F.filter("by_rarity", lambda x: F.abs(x["offset"] - first["offset"]) >= SHINGLE), 0)
    kept = lists.where(first["n"] > 0).select(F.xxhash64("item_id", "window").alias("key"), "item_id", "window", "length", first["h"].alias("h"), first["offset"].alias("offset"), other["h"].alias("other_h"), other["offset"].alias("other_offset"))
    return materialize(kept, "prefixes")


def hits(rows: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, n_hit, spans, items), written, of the documents in which a window stands."""
    needed = prefixes(found, windows)
    start = (F.col("pos") - F.col("offset")).cast("int")
    matched = found.where("h is not null").join(_bounded(needed.drop("item_id", "window")), "h").where((start >= 0) & (start + F.col("length") <= F.col("n_words"))).select("row", start.alias("start"), "key", "other_h", (start + F.col("other_offset")).alias("other_pos"))
    standing = found.where("h is not null").select("row", F.col("pos").alias("other_pos"), F.col("h").alias("other_h"))
    both = matched.where("other_h is not null").join(standing, ["row", "other_pos", "other_h"], "left_semi").unionByName(matched.where("other_h is null"))
    joined = both.select("row", "start", "key").join(_bounded(needed.select("key", "item_id", "window", "length")), "key")
    candidates = materialize(joined.select("row", "start", "length", "window", "item_id"), "candidates")
    lists = candidates.groupBy("row").agg(F.collect_list(F.struct("start", "length", "window", "item_id")).alias("candidates"))
    texts = rows.select("row", "text").join(_bounded(materialize(lists, "candidates")), "row")
    same = lambda w, c: fold(F.array_join(F.slice(w, c["start"] + 1, c["length"]), " ")) == c["window"]
    # the words are bound once: as a column they would be cut anew for each candidate
    real = texts.select("row", let(words_of(F.col("text")), lambda w: F.filter("candidates", lambda c: same(w, c))).alias("hits")).where(F.size("hits") > 0)
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length")))))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda c: c["item_id"])))
    end = lambda s: s["start"] + s["length"]
    nothing = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", nothing, lambda a, s: F.struct((a["hit"] + F.greatest(end(s) - F.greatest(a["end"], s["start"]), F.lit(0))).cast("long").alias("hit"), F.greatest(a["end"], end(s)).alias("end"))
    )["hit"]
    return materialize(real.select("row", spans.alias("spans"), items.alias("items")).select("row", covered.alias("n_hit"), "spans", "items"), "hits")


def judge(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """decontaminate() of keyed rows (row, text, doc_id), with `row`."""
    windows = materialize(item_windows(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text"), window), "windows")
    lengths = [r[0] for r in windows.select(F.least("length", F.lit(SHINGLE))).distinct().collect()]  # at most SHINGLE
    found = places(rows, windows, sorted(lengths, reverse=True) or [SHINGLE])
    marked = hits(rows, found, windows)
    each = found.where("pos is null or pos = 0").select("row", "doc_id", "n_words").distinct()
    none = lambda kind: F.array().cast(kind)
    joined = each.join(_bounded(marked), "row", "left")
    counted = joined.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none("array<struct<start:int,length:int>>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, contaminated) for each row of documents.

    `spans` are (start, length) of the windows found, in words; `items` the ids of items with a window found, sorted as
    strings; a document is contaminated if at least `share` of its words, and at least one, lie inside a window.
    A null or empty text has no words and so no hit; rows are judged one by one, those that repeat a doc_id (or have
    none) too; items without words, or with a null text, have no window, and a null item_id counts as an item `null`.
    Whole texts count, however long.  An empty benchmark hits nothing; no documents give no rows; other columns are ignored.
    """
    return judge(keyed(documents), benchmark, window, share).drop("row")


def clean(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """The rows of documents (doc_id, text, *keep) that decontaminate() doesn't find contaminated."""
    rows = keyed(documents, keep)
    bad = materialize(judge(rows, benchmark, window, share).where("contaminated").select("row"), "contaminated")
    return rows.join(_bounded(bad), "row", "left_anti").select("doc_id", "text", *keep)
