"""Imports from tagged, cited, delimited and paged text, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.identifiers import decode_entities, split_list, trimmed
from lectern.operators.journals import keyed_join


def toc_articles(pages: DataFrame, html: str, ident: str, block: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a contents page: split at `block`, each field by a pattern with one group; the first of an article stays."""
    spread = pages.select(F.col(ident), F.posexplode(F.split(html, block)).alias("pos", "part"))
    found = spread.select(ident, "pos", *(F.trim(decode_entities(F.regexp_extract("part", p, 1))).alias(n) for n, p in fields.items()))
    first = next(iter(fields))
    rank = F.row_number().over(Window.partitionBy(ident, first).orderBy("pos"))
    return found.where(F.col(first) != "").withColumn("__n", rank).where("__n = 1").drop("__n")


def tagged_records(texts: DataFrame, text: str, ident: str) -> DataFrame:
    """(ident, record, tag, values): two-character tags at line starts; lines without one go on with the tag before."""
    blocks = texts.select(ident, F.posexplode(F.split(text, r"\r?\n[ \t]*\r?\n+")).alias("record", "block"))
    lines = blocks.select(ident, "record", F.posexplode(F.split("block", r"\r?\n")).alias("line", "value"))
    tag = F.nullif(F.regexp_extract("value", r"^%?([A-Z][A-Z0-9])\s*-?\s", 1), F.lit(""))
    upto = Window.partitionBy(ident, "record").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("tag", tag).withColumn("n", F.count("tag").over(upto)).withColumn("tag", F.last("tag", ignorenulls=True).over(upto)).where("tag is not null")
    value = F.trim(F.regexp_replace("value", r"^%?[A-Z][A-Z0-9]\s*-?\s", ""))
    joined = numbered.withColumn("value", value).groupBy(ident, "record", "n", "tag").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), " ")).alias("value"))
    return joined.groupBy(ident, "record", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))


CITATION = r"^\s*(?:\[[0-9]+\]\s*)?(.+?)\.\s*(.+?)\s*\[J\]\.?\s*(.+?),\s*([0-9]{4})(?:,\s*([0-9]+))?(?:\(([^)]+)\))?(?::\s*([0-9\-–]+))?"


def parse_citation(line: Column) -> Column:
    """struct of a numbered journal citation `authors. title[J]. journal, year, volume(issue): pages`; null for others."""
    g = lambda i: F.nullif(F.regexp_extract(line, CITATION, i), F.lit(""))
    return F.when(line.rlike(CITATION), F.struct(split_list(g(1)).alias("authors"), g(2).alias("title"), g(3).alias("journal_name"), g(4).alias("year"), g(5).alias("volume"), g(6).alias("issue"), g(7).alias("pages")))


def filled_score(row: list[str], authors: str, keywords: str) -> Column:
    return sum((F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", 1).otherwise(0) for c in row), F.size(F.coalesce(F.col(authors), F.array().cast("array<string>"))) + F.size(F.coalesce(F.col(keywords), F.array().cast("array<string>"))))


def reconcile(rows: DataFrame, title: Column, score: Column, order: list[Column]) -> DataFrame:
    """Of the same record in several formats the one with the most filled fields, the earlier one of equals."""
    key = F.lower(F.regexp_replace(title, r"[\s　]+", ""))
    rank = F.row_number().over(Window.partitionBy("title_key").orderBy(score.desc(), *order))
    return rows.withColumn("title_key", key).where("title_key <> ''").withColumn("__n", rank).where("__n = 1").drop("__n")


def mapped_preview(rows: DataFrame, key: Column, order: str, keep: str = "first") -> DataFrame:
    """One row for each key, its first or last version, at the place where the key first stands."""
    o = F.col(order)
    version = F.min_by if keep == "first" else F.max_by
    others = [c for c in rows.columns if c != order]
    return rows.withColumn("map_key", key).where("map_key <> ''").groupBy("map_key").agg(F.min(o).alias("place"), F.count(F.lit(1)).alias("versions"), *(version(F.col(c), o).alias(c) for c in others))


#: Names under which fields of imported records come (fixed values).
RECORD_ALIASES = {
    "title": ("title", "题名", "篇名"), "authors": ("authors", "作者"), "journal_name": ("journalName", "刊名", "来源", "期刊"), "issn": ("issn", "ISSN"), "doi": ("doi", "DOI"),
    "abstract": ("abstract", "摘要"), "issued_date": ("issuedDate", "发表时间", "年"), "volume": ("volume", "卷"), "issue": ("issue", "期"), "pages": ("pages", "页码"),
    "url": ("url", "链接", "URL"), "keywords": ("keywords", "关键词", "主题词"), "language": ("language",),
}


def imported_records(rows: DataFrame, language: str = "zh") -> DataFrame:
    """Records under their canonical names, the first alias that is filled; lists are cut, those without a title left out."""
    text = lambda options: F.coalesce(*(F.nullif(trimmed(F.col(f"`{c}`").cast("string")), F.lit("")) for c in options if c in rows.columns), F.lit(""))
    made = [split_list(text(a)).alias(n) if n in ("authors", "keywords") else text(a).alias(n) for n, a in RECORD_ALIASES.items() if n != "language"]
    lang = F.coalesce(F.nullif(text(RECORD_ALIASES["language"]), F.lit("")), F.lit(language))
    source = F.when(F.size("keywords") > 0, "imported")
    return rows.select(*made, lang.alias("language")).where("title <> ''").withColumn("keywords_source", source)


def read_delimited(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]] = RECORD_ALIASES, language: str = "zh") -> DataFrame:
    """Comma or tab files whose headers are known by any alias; lists are cut, a record without language is Chinese, rows
    without a title are left out."""
    from lectern.operators.journals import catalog_entry

    head = spark.read.text(path).limit(1).first()
    sep = "\t" if head and "\t" in head[0] else ","
    rows = catalog_entry(spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"'), aliases)
    lists = {c: split_list(F.col(c)) for c in ("authors", "keywords") if c in rows.columns}
    own = {"language": F.coalesce(F.nullif("language", F.lit("")), F.lit(language))} if "language" in rows.columns else {}
    return rows.where("title <> ''").withColumns({**lists, **own})


def journal_feed(works: DataFrame, since: str) -> DataFrame:
    """Works (journal, doi, title, abstract, date, language, url) since a day, DOIs in lower case, tags out of abstracts."""
    kept = works.where(F.col("doi").isNotNull() & F.col("title").isNotNull() & (F.coalesce("date", F.lit("")) >= since))
    doi = F.lower("doi")
    return kept.select("journal", doi.alias("doi"), "title", F.trim(F.regexp_replace(F.coalesce("abstract", F.lit("")), "<[^>]+>", " ")).alias("abstract"), F.coalesce("language", F.lit("unknown")).alias("language"), "date", F.coalesce("url", F.concat(F.lit("https://doi.org/"), doi)).alias("url"))


def feed_status(works: DataFrame, feed: DataFrame, known: DataFrame) -> DataFrame:
    """Of each journal the works found and those of its feed that are new here (known: doi)."""
    found = works.groupBy("journal").agg(F.count(F.lit(1)).alias("found"))
    new = feed.join(known.select(F.lower("doi").alias("doi")), "doi", "left_anti").groupBy("journal").agg(F.countDistinct("doi").alias("inserted"))
    return found.join(new, "journal", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))


def fill_access(rows: DataFrame, locations: DataFrame, publishers: DataFrame) -> DataFrame:
    """rows (doi, issn, abstract, ...) with open-access fields of locations (doi, best_url, oa_status, license, abstract), set
    only where a best address exists, and publisher and in_doaj of publishers (issn); a missing abstract is filled."""
    at = locations.where("doi is not null").dropDuplicates(["doi"]).select("doi", F.col("best_url").alias("__url"), F.col("oa_status").alias("__status"), F.col("license").alias("__license"), F.col("abstract").alias("__abstract"))
    by = publishers.where("issn is not null").dropDuplicates(["issn"]).select("issn", F.col("publisher").alias("__publisher"), F.col("in_doaj").alias("__doaj"))
    joined = keyed_join(keyed_join(rows, at, "doi"), by, "issn")
    has = F.col("__url").isNotNull()
    own = [c for c in rows.columns if c not in ("abstract", "publisher")]
    publisher = F.coalesce("publisher", "__publisher") if "publisher" in rows.columns else F.col("__publisher")
    return joined.select(*own, F.coalesce("abstract", "__abstract").alias("abstract"), has.alias("open_access"), F.when(has, F.col("__status")).alias("oa_status"), F.when(has, F.col("__license")).alias("license"), F.when(has, F.col("__url")).alias("oa_url"), publisher.alias("publisher"), F.coalesce("__doaj", F.lit(False)).alias("in_doaj"))


def read_catalog(spark: SparkSession, paths: str | list[str], aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    from lectern.operators.journals import catalog_entry

    return catalog_entry(spark.read.csv(paths, header=True, multiLine=True, escape='"'), aliases)


def enrich(rows: DataFrame, lookup: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """rows with missing values of `fill` taken from a lookup by key (one row for each key)."""
    other = lookup.select(key, *(F.col(c).alias(f"__{c}") for c in fill)).where(F.col(key).isNotNull()).dropDuplicates([key])
    joined = keyed_join(rows, other, key)
    return joined.select(*(c for c in rows.columns if c not in fill), *(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in fill))
