"""A reader's own annotations: judgments, bulk changes with undo, translation cache, reading state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.identifiers import fingerprint, normalize_doi
from lectern.operators.journals import keyed_join


def latest_judgments(log: DataFrame) -> DataFrame:
    """The standing judgment of each paper; one that was cleared has none."""
    last = log.groupBy("paper_id").agg(F.max_by(F.struct("decision", "at"), F.struct("at", "ord")).alias("last"))
    return last.select("paper_id", "last.decision", "last.at").where("decision <> 'cleared'")


def judgment_counts(judgments: DataFrame) -> DataFrame:
    return judgments.agg(F.count_if(F.col("decision") == "interested").alias("interested"), F.count_if(F.col("decision") == "muted").alias("muted"), F.count(F.lit(1)).alias("total"))


def can_undo(log: DataFrame) -> DataFrame:
    """Actions that may be undone: no later action of the same kind touches one of their ids."""
    last = log.groupBy("subject", "kind").agg(F.max("at").alias("last_at"))
    blocked = log.join(last, ["subject", "kind"]).where("last_at > at").select("action_id").distinct()
    return log.select("action_id", "kind").distinct().join(blocked, "action_id", "left_anti")


def cache_status(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts (subject, field, target, text) with the state of their translations: ok, failed, missing or unavailable.

    A cached row holds for exactly the text whose fingerprint it carries.
    """
    keyed = texts.withColumn("fingerprint", fingerprint(F.col("text")))
    found = keyed.join(cache.select("subject", "field", "target", "fingerprint", F.col("status").alias("cached")), ["subject", "field", "target", "fingerprint"], "left")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    return found.withColumn("status", F.when(empty, "unavailable").otherwise(F.coalesce("cached", F.lit("missing")))).drop("cached")


def reading_key(doi: Column, subject: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), subject)


def union_streams(first: DataFrame, second: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (subject, doi) of both streams without those linked to a paper, one for each work; the first stream wins."""
    both = first.withColumn("stream", F.lit(0)).unionByName(second.withColumn("stream", F.lit(1)), allowMissingColumns=True)
    free = both.join(linked.select("subject"), "subject", "left_anti").withColumn("reading_key", reading_key(F.col("doi"), F.col("subject")))
    best = free.groupBy("reading_key").agg(F.min(F.struct("stream", "subject")).alias("best"))
    return best.select("reading_key", "best.subject", "best.stream")


def run_items(items: DataFrame, papers: DataFrame) -> DataFrame:
    """The items (run_id, paper_id, rank, score) of runs with their papers, in order of rank."""
    return items.join(papers.withColumnRenamed("id", "paper_id"), "paper_id").orderBy("run_id", "rank")


def pick_items(picks: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """Picks (run_id, item_id, rank) of a stream with their items and the days of their runs."""
    return picks.join(items.withColumnRenamed("id", "item_id"), "item_id").join(runs.select("run_id", "run_date"), "run_id")


def library_papers(library: DataFrame, papers: DataFrame) -> DataFrame:
    return library.join(papers.withColumnRenamed("id", "paper_id"), "paper_id")


def judged_papers(judgments: DataFrame, papers: DataFrame, decision: str) -> DataFrame:
    """Papers with a judgment, the newest judgment first."""
    return judgments.where(F.col("decision") == decision).join(papers.withColumnRenamed("id", "paper_id"), "paper_id").orderBy(F.col("at").desc(), "paper_id")


def enrich_cards(cards: DataFrame, library: DataFrame, interpretations: DataFrame, states: DataFrame, judgments: DataFrame, translations: DataFrame) -> DataFrame:
    """Cards (id) with what a reader did to them; every other side is brought to one row a paper first."""
    one = lambda df, *aggs: df.groupBy(F.col("paper_id").alias("id")).agg(*aggs)
    made = cards.join(one(library, F.bool_or("starred").alias("starred")), "id", "left").join(one(interpretations, F.count(F.lit(1)).alias("interpretations")), "id", "left")
    made = made.join(one(states, F.max("browsed_at").alias("browsed_at")), "id", "left").join(one(judgments, F.max_by("decision", "at").alias("decision")), "id", "left")
    made = made.join(one(translations, F.count_if(F.col("status") == "ok").alias("translations")), "id", "left")
    return made.withColumns({"starred": F.coalesce("starred", F.lit(False)), "interpretations": F.coalesce("interpretations", F.lit(0)), "translations": F.coalesce("translations", F.lit(0))})


def snapshots(materials: DataFrame) -> DataFrame:
    """Of each interpretation the numbers of the sentences it kept, in order."""
    kept = materials.groupBy("interp_id").agg(F.array_sort(F.collect_list(F.struct("ord", "sid"))).alias("kept"))
    return kept.select("interp_id", F.transform("kept", lambda x: x["sid"]).alias("sids"))


def evidence_lookup(wanted: DataFrame, materials: DataFrame) -> DataFrame:
    """wanted (interp_id, sid) with text and state: found, unknown (no such number), no-snapshot (nothing was kept)."""
    have = materials.select("interp_id").distinct().withColumn("__kept", F.lit(True))
    found = wanted.join(materials.select("interp_id", "sid", "text"), ["interp_id", "sid"], "left").join(have, "interp_id", "left")
    state = F.when(F.col("text").isNotNull(), "found").when(F.col("__kept").isNotNull(), "unknown").otherwise("no-snapshot")
    return found.select("interp_id", "sid", "text", state.alias("state"))


def details(wanted: DataFrame, papers: DataFrame, journals: DataFrame, library: DataFrame, fulltexts: DataFrame, judgments: DataFrame) -> DataFrame:
    """Everything about the papers of a list of ids at once."""
    base = papers.join(wanted.select("id"), "id", "left_semi")
    full = fulltexts.select(F.col("paper_id").alias("id"), F.length("text").alias("fulltext_chars"))
    own = library.select(F.col("paper_id").alias("id"), "starred", "read_state")
    said = judgments.select(F.col("paper_id").alias("id"), "decision")
    joined = base.join(journals.select("journal_id", F.col("name").alias("journal_name"), "official"), "journal_id", "left").join(own, "id", "left").join(full, "id", "left").join(said, "id", "left")
    return joined.withColumn("starred", F.coalesce("starred", F.lit(False)))


def overview(library: DataFrame, papers: DataFrame) -> DataFrame:
    """One row of counts over a library and all papers."""
    state = lambda x: F.count_if(F.col("read_state") == x)
    of_library = library.agg(F.count(F.lit(1)).alias("total"), F.count_if("starred").alias("starred"), state("read").alias("n_read"), state("reading").alias("n_reading"), F.count_if(F.col("starred") & (F.col("read_state") == "unread")).alias("unread"))
    status = lambda x: F.count_if(F.col("status") == x)
    of_papers = papers.agg(F.count(F.lit(1)).alias("papers"), F.count_if((F.col("status") == "eligible") & (F.col("basis") == "official")).alias("eligible"), status("reference").alias("reference"), status("pending").alias("pending"))
    return of_library.join(F.broadcast(of_papers))  # one row each


def leaks(papers: DataFrame) -> DataFrame:
    """Papers whose topic labels stand among their keywords (id, leaked)."""
    low = F.transform("keywords", F.lower)
    return papers.select("id", F.filter(F.array_distinct(low), lambda k: F.array_contains("topics", k)).alias("leaked")).where(F.size("leaked") > 0)


#: How keywords of a source are called (fixed values).
KEYWORD_LABELS = {"imported": "作者关键词（题录导入）", "imported:cnki": "作者关键词（题录导入）", "openalex": "OpenAlex 提取的关键词"}


def vocabulary(papers: DataFrame) -> DataFrame:
    """Keywords, database topics and own topics kept apart, with where the keywords come from."""
    by_source = F.element_at(F.create_map(*(F.lit(x) for pair in KEYWORD_LABELS.items() for x in pair)), F.coalesce("keywords_source", F.lit("")))
    label = F.coalesce(by_source, F.when(F.size("keywords") > 0, "关键词").otherwise("作者关键词"))
    return papers.select("id", F.struct(F.col("keywords").alias("items"), label.alias("label"), F.coalesce(F.col("keywords_source").isin("imported", "imported:cnki"), F.lit(False)).alias("author_supplied")).alias("keywords"), F.col("db_topics"), F.col("topics").alias("own_topics"))


def undo(rows: DataFrame, log: DataFrame, action: int, kind: str, ident: str = "id") -> DataFrame:
    """rows with the column `kind` as it was before an action, given as (action_id, kind, subject, before); others stay."""
    before = log.where((F.col("action_id") == action) & (F.col("kind") == kind)).select(F.col("subject").alias(ident), F.col("before").alias("__before"), F.lit(True).alias("__hit"))
    restored = F.when(F.col("__hit"), F.col("__before").cast(dict(rows.dtypes)[kind])).otherwise(F.col(kind))
    return rows.join(before, ident, "left").withColumn(kind, restored).select(*rows.columns)


def reading_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows (subject, doi, linked) of all streams with the state of their work: that of the paper a row is linked to, else
    the newest under its DOI, else its own.  states: (subject, doi, state, at); keys that are missing join with nothing."""
    newest = lambda key, name: states.where(key.isNotNull()).groupBy(key.alias(f"__{name}")).agg(F.max_by("state", F.struct("at", "state")).alias(f"__{name}_state"))
    by_doi = F.concat(F.lit("doi:"), normalize_doi(F.col("doi")))
    wanted = rows.withColumns({"__linked": F.col("linked"), "__doi": by_doi, "__own": F.col("subject")})
    for name, key in (("linked", F.col("subject")), ("doi", by_doi), ("own", F.col("subject"))):
        wanted = keyed_join(wanted, newest(key, name), f"__{name}")
    return wanted.select(*rows.columns, F.coalesce("__linked_state", "__doi_state", "__own_state").alias("state"))
