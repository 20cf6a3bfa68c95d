"""The discovery list: filters, counts, order and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.identifiers import clean_placeholder, trimmed
from lectern.functions.language import in_scope
from lectern.functions.dates import best_pub_date

#: Title patterns of rows that are no research papers (fixed values).
NON_RESEARCH = (
    "^新书目$", "^书目$", "^书讯$", "^书评$",
    "^(征稿|稿约|投稿须知|征稿启事|征文启事)",
    "^(简讯|消息|动态|会议|会议通知|启事|通知|公告)",
    "^(更正|勘误|索引|目录|编后记|编者按|卷首语|发刊词|致读者|稿约)",
    "^(致谢|作者索引|总目录|年度总目录)",
    "(稿约|征稿启事|投稿指南)$",
)


def search(columns: Sequence[str], words: str) -> Column:
    """Any of the columns holds the words, case aside."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(words.lower())) for c in columns])


def all_of(conditions: Sequence[Column]) -> Column:
    """Rows that meet every condition; none asks for nothing."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def eligibility_filter(name: str, status: Column, basis: Column, open_access: Column) -> Column:
    """Rows by the standing of their journal; the official list holds no other kind of eligible row."""
    return {
        "all": F.lit(True),
        "official": (status == "eligible") & (basis == "official"),
        "reference": status == "reference",
        "pending": status == "pending",
        "unverified": ~status.eqNullSafe(F.lit("eligible")),
        "open_access": open_access,
    }[name]


def is_research(title: Column, pages: Column, authors: Column) -> Column:
    """Has a title, which is none of a contents page or the like, and is no placeholder row of one page `n-n` and no author."""
    t = trimmed(F.coalesce(title, F.lit("")))
    one_page = F.coalesce(pages.rlike(r"^([0-9]+)-\1$"), F.lit(False))
    return (t != "") & ~t.rlike("|".join(NON_RESEARCH)) & ~(one_page & (trimmed(F.coalesce(authors, F.lit(""))) == ""))


def kind_of(discovery_date: Column, today: str, was_shown: Column) -> Column:
    return F.when(discovery_date == today, "new").when(was_shown, "shown").otherwise("catchup")


def discovery_counts(rows: DataFrame) -> DataFrame:
    """One row of counts over (kind, core, language): the three kinds are exclusive and sum to the total."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("new", "catchup", "shown")),
        F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_cross"), F.count_if(~in_scope(F.col("language"))).alias("outside_scope"),
    )


def topic_counts(rows: DataFrame, topics: str) -> DataFrame:
    return rows.select(F.explode(topics).alias("topic"), "kind").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "new").alias("n_new"))


def discovery_order(rows: DataFrame) -> list[Column]:
    kind = F.when(F.col("kind") == "new", 0).when(F.col("kind") == "catchup", 1).otherwise(2)
    return [F.col("core").desc(), F.col("browsed"), kind, F.col("score").desc(), F.col("date_ms").desc_nulls_last(), F.col("id")]


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list; enrich only what it returns."""
    size = max(1, min(100, size))
    return rows.orderBy(*order).offset(size * (max(1, number) - 1)).limit(size)


def excluded_by_all(text: Column, topics: Column) -> Column:
    """A record goes only if every topic that found it excludes it: topics is array<struct<excluded array<string>>>."""
    low = F.lower(text)
    return (F.size(topics) > 0) & F.forall(topics, lambda t: F.exists(t["excluded"], lambda w: F.contains(low, F.lower(w))))


def has_tag(tags: Column, value: str) -> Column:
    """Membership in a list of tags or topics; a null list has none."""
    return F.coalesce(F.array_contains(tags, value), F.lit(False))


def with_tag(rows: DataFrame, ident: str, tagged: DataFrame, tag: str) -> DataFrame:
    """Rows whose id carries a tag in another table (ident, tags): a semi join."""
    return rows.join(tagged.where(has_tag(F.col("tags"), tag)).select(ident), ident, "left_semi")


def in_window(dates: Sequence[Column], today: str, lookback: int, least: int) -> Column:
    """The first date there is, as text, lies within the last `lookback` days, at least `least` of them."""
    since = F.date_format(F.date_sub(F.lit(today).cast("date"), max(lookback, least)), "yyyy-MM-dd")
    return F.coalesce(F.coalesce(*dates) >= since, F.lit(False))


def brief_window(online: Column, discovery: Column, issued: Column, today: str, lookback: int) -> Column:
    return in_window([online, discovery, issued], today, lookback, 45)


def discovery_window(online: Column, discovery: Column, issued: Column, status: Column, today: str, lookback: int) -> Column:
    return in_window([discovery, online, issued], today, lookback, 30) & ~status.eqNullSafe(F.lit("excluded"))


def library_filter(starred: bool | None = None, read_state: str | None = None, language: str | None = None, journal: str | None = None, topic: str | None = None, tag: str | None = None, since: str | None = None, until: str | None = None, words: str | None = None) -> Column:
    """The conditions that are given, all of them, on columns starred, read_state, language, journal_name, topics, tags,
    published_online, issued_date, discovery_date, title, abstract, authors, note."""
    date = F.coalesce("published_online", "issued_date", "discovery_date")
    given = [
        None if starred is None else F.col("starred") == starred, read_state and F.col("read_state") == read_state, language and F.col("language") == language,
        journal and search(["journal_name"], journal), topic and has_tag(F.col("topics"), topic), tag and has_tag(F.col("tags"), tag), since and date >= since, until and date <= until,
        words and search(["title", "abstract", "authors", "note"], words),
    ]
    return all_of([c for c in given if c is not None])


def journal_search(journals: DataFrame, words: str, limit: int = 300) -> DataFrame:
    """Journals whose name, ISSN or a variant of the name holds the words, verified ones first."""
    low = words.lower()
    variant = F.coalesce(F.exists("name_variants", lambda v: F.contains(F.lower(v), F.lit(low))), F.lit(False))
    return journals.where(search(["name", "issn"], words) | variant).orderBy(F.col("verified").desc(), "name", "journal_id").limit(limit)


def discovery_list(rows: DataFrame, muted: DataFrame, today: str, *, journal_filter: str = "all", words: str = "", category: str = "", browse: str = "", since: str = "", topic: str = "", language: str = "", scope: str = "zh-en", include_muted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cards with `kind` and `muted`, one row of counts by language) of rows in the window.

    Muted rows go first, then the filters in turn, then rows without any topic, core or cross.  Languages are counted
    before the scope is applied, so that what it hides can be told.  Columns: id, title, abstract, journal_name, keywords,
    language, status, basis, open_access, category_ids, topics, cross_topics, browsed_at, created_at, discovery_date, shown.
    """
    marked = rows.join(muted.select("id").distinct().withColumn("muted", F.lit(True)), "id", "left").withColumn("muted", F.coalesce("muted", F.lit(False)))
    has_words = search(["title", "abstract", "journal_name"], words) | F.contains(F.lower(F.array_join("keywords", " ")), F.lit(words.lower()))
    wanted = [
        None if include_muted else ~F.col("muted"), eligibility_filter(journal_filter, F.col("status"), F.col("basis"), F.col("open_access")), has_words if words else None,
        has_tag(F.col("category_ids"), category) if category else None, F.col("browsed_at").isNull() if browse == "unseen" else F.col("browsed_at").isNotNull() if browse == "seen" else None,
        F.col("created_at") > since if since else None, has_tag(F.col("topics"), topic) | has_tag(F.col("cross_topics"), topic) if topic else None,
        (F.size("topics") > 0) | (F.size("cross_topics") > 0),
    ]
    relevant = marked.where(all_of([c for c in wanted if c is not None]))
    own = F.coalesce("language", F.lit("unknown"))
    counts = relevant.agg(*(F.count_if(own == x).alias(x) for x in ("zh", "en", "id", "other", "unknown")), F.count(F.lit(1)).alias("all_languages"), F.count_if(~in_scope(F.col("language"))).alias("outside_scope"))
    shown = relevant.where(in_scope(F.col("language"), language or None)) if language or scope == "zh-en" else relevant
    return shown.withColumn("kind", kind_of(F.col("discovery_date"), today, F.col("shown"))), counts


def category_counts(cards: DataFrame) -> DataFrame:
    """Of each category its cards and the new ones; a card counts in each of its categories."""
    return cards.select(F.explode("category_ids").alias("category"), "kind").groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "new").alias("n_new"))


def cards(papers: DataFrame) -> DataFrame:
    """What a list shows of each paper: cleaned volume, issue and pages, its best date, whether it can be read."""
    date = best_pub_date(F.col("published_online"), F.col("published_print"), F.col("issued_date"))
    clean = [clean_placeholder(F.col(c)).alias(c) for c in ("volume", "issue", "pages")]
    return papers.select("id", trimmed(F.col("title")).alias("title"), "journal_name", "language", *clean, date["value"].alias("date"), date["precision"].alias("precision"), date["kind"].alias("date_kind"), (F.length(F.coalesce("abstract", F.lit(""))) > 0).alias("has_abstract"))
