"""Texts as evidence: sentences, chunks, citations, numbers, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.language import let
from lectern.session import ship

EVIDENCE_CHARS = 46_000


def split_sentences(c: Column, longest: int = 400, piece: int = 300) -> Column:
    """Sentences without those of one character; one of over `longest` characters in pieces of `piece`."""
    parts = F.transform(F.split(c, r"(?<=[.!?。！？；;])"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    cut = lambda s: F.when(F.length(s) > longest, F.transform(F.sequence(F.lit(1), F.length(s), F.lit(piece)), lambda i: F.substring(s, i, F.lit(piece)))).otherwise(F.array(s))
    return F.flatten(F.transform(F.filter(parts, lambda s: F.length(s) > 1), cut))


def split_chunks(c: Column, size: int = 2200) -> Column:
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(size)), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def fitting(sentences: Column, most_chars: int, before: Column) -> Column:
    """How many sentences, from the first, keep the sum of characters within the limit, with so many before them."""
    start = F.struct(F.lit(0).alias("n"), before.cast("long").alias("chars"))
    step = lambda a, s: F.struct((a["n"] + F.when(a["chars"] + F.length(s) <= most_chars, 1).otherwise(0)).alias("n"), (a["chars"] + F.length(s)).alias("chars"))
    return F.aggregate(sentences, start, step, lambda a: a["n"])


def build_evidence(documents: DataFrame, most_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """(doc_id, sid, sentence): sentences numbered S1.. until their characters would exceed the limit; row by row."""
    kept = let(split_sentences(F.col("text")), lambda s: F.slice(s, F.lit(1), fitting(s, most_chars, F.lit(0))))
    each = documents.select("doc_id", F.posexplode(kept).alias("pos", "sentence"))
    return each.select("doc_id", F.concat(F.lit("S"), (F.col("pos") + 1).cast("string")).alias("sid"), "sentence")


def cited(reply: Column) -> Column:
    """The distinct numbers cited as [S12], in order of first use."""
    return F.array_distinct(F.regexp_extract_all(reply, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def validate_grounding(reply: Column, sids: Column) -> Column:
    """struct<cited, bogus, coverage>: cited numbers that exist and that don't, share of existing ones cited (2 digits)."""
    found = cited(reply)
    return F.struct(F.array_intersect(found, sids).alias("cited"), F.array_except(found, sids).alias("bogus"), F.round(F.size(F.array_intersect(found, sids)) / F.greatest(F.size(sids), F.lit(1)), 2).alias("coverage"))


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0)))


def missing_numbers(source: Column, target: Column) -> Column:
    return F.filter(numbers_in(source), lambda n: ~F.contains(target, n))


def looks_like_garbage(c: Column, share: float = 0.15, least: int = 60) -> Column:
    good = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}\p{P}\s]", ""))
    return (F.length(c) >= least) & (1 - good / F.length(c) > share)


def looks_scanned(chars: Column, pages: Column) -> Column:
    return chars < F.greatest(F.lit(200), pages * 50)


def evidence_scope(fulltext: Column, abstract: Column) -> Column:
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(has(fulltext), "fulltext").when(has(abstract), "abstract").otherwise("metadata")


def detect_sections(c: Column, heading: str, least: int = 200, drop: int = 40) -> Column:
    """array<struct<heading, text>> of a text's lines: a heading line opens a section once the current one has over `least`
    characters; sections of up to `drop` characters go."""
    empty = F.array().cast("array<struct<heading:string,text:string>>")
    start = F.struct(empty.alias("done"), F.lit("").alias("heading"), F.lit("").alias("text"))
    section = lambda a: F.array(F.struct(a["heading"].alias("heading"), a["text"].alias("text")))

    def step(a: Column, line: Column) -> Column:
        opens = line.rlike(heading) & ((F.length(a["text"]) > least) | (F.size(a["done"]) + F.length(a["text"]) == 0))
        joined = F.when(a["text"] == "", line).otherwise(F.concat(a["text"], F.lit("\n"), line))
        done = F.when(opens & (a["text"] != ""), F.concat(a["done"], section(a))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(opens, F.trim(line)).otherwise(a["heading"]).alias("heading"), F.when(opens, F.lit("")).otherwise(joined).alias("text"))

    all_of = F.aggregate(F.split(c, "\n"), start, step, lambda a: F.concat(a["done"], section(a)))
    return F.filter(all_of, lambda s: F.length(s["text"]) > drop)


def apply_model(texts: DataFrame, model: Callable[[list[str]], list[str]], partitions: int | None = None) -> DataFrame:
    """(subject, text, reply): a caller's function on batches of texts; it is called in the executors' tasks.

    Choose the work before (texts without a valid cache row) and check replies after (citations, numbers).  Texts are dealt over
    `partitions` tasks, as many as the cluster has cores if none are given.  calls.work_through() keeps limits and replies.
    """

    def run(batches):
        for batch in batches:
            batch["reply"] = model(batch["text"].tolist())
            yield batch

    ship(texts.sparkSession)
    return texts.select("subject", "text").repartition(partitions or texts.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"subject {dict(texts.dtypes)['subject']}, text string, reply string")


def parse_keyed_reply(c: Column) -> Column:
    """map<id, text> of a reply that holds one JSON object, in code fences or among other words."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), "map<string,string>")


def numbered_sentences(parts: DataFrame, most_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """(doc_id, sid, section, sentence) of parts (doc_id, place, section, text) in order of place: the abstract, then sections.

    Sentences are numbered S1.. over all parts until their characters would exceed the limit.  Each part is cut to what may be
    kept of it at all, then sums over the parts of a document say where it begins; only kept sentences become rows.
    """
    lists = parts.select("doc_id", "place", "section", split_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    held = lists.select("doc_id", "place", "section", chars.alias("chars"), F.size("s").alias("size"), F.slice("s", F.lit(1), fitting(F.col("s"), most_chars, F.lit(0))).alias("s"))
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumns({"chars": F.coalesce(F.sum("chars").over(before), F.lit(0)), "size": F.coalesce(F.sum("size").over(before), F.lit(0))}).where(F.col("chars") <= most_chars)
    each = placed.select("doc_id", "section", "size", F.posexplode(F.slice("s", F.lit(1), fitting(F.col("s"), most_chars, F.col("chars")))).alias("pos", "sentence"))
    return each.select("doc_id", F.concat(F.lit("S"), (F.col("size") + F.col("pos") + 1).cast("string")).alias("sid"), "section", "sentence")


def replace_bogus(reply: Column, sids: Column, mark: str = "[?]") -> Column:
    """The reply with citations of numbers that don't exist replaced."""
    bogus = F.array_except(cited(reply), sids)
    return F.aggregate(bogus, reply, lambda text, sid: F.replace(text, F.concat(F.lit("["), sid, F.lit("]")), F.lit(mark)))


def material_rows(evidence: DataFrame, replies: DataFrame) -> DataFrame:
    """One row for each sentence that a reply was given (doc_id, sid, sentence), with whether the reply cites it."""
    found = replies.select("doc_id", cited(F.col("reply")).alias("__cited"))
    joined = evidence.join(found, "doc_id")
    return joined.select("doc_id", "sid", "sentence", F.length("sentence").alias("chars"), F.array_contains("__cited", F.col("sid")).alias("cited"))


def fulltext_rows(texts: DataFrame, heading: str, pages: str = "pages") -> DataFrame:
    """texts (paper_id, text, pages) worth keeping, one row a paper, with their sections; scans and garbage are left out."""
    good = texts.where(F.col("text").isNotNull() & ~looks_scanned(F.length("text"), F.col(pages)) & ~looks_like_garbage(F.col("text")))
    longest = good.groupBy("paper_id").agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"))
    return longest.withColumn("sections", detect_sections(F.col("text"), heading))
