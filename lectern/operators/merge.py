"""Merging records of one work, and keyed upserts whose rule is given column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.identifiers import is_placeholder, normalize_doi, normalize_title
from lectern.operators.journals import keyed_join


def first_where(c: Column, ok: Column, order: Column) -> Column:
    """Of a group, the value of the first row (by order) for which ok holds."""
    return F.min_by(c, F.when(ok, order))


def longest(c: Column, order: Column) -> Column:
    """The longest text, the first of equally long ones."""
    return _beside_longest(c, c, order)


def _beside_longest(c: Column, text: Column, order: Column) -> Column:
    return F.min_by(c, F.when(text.isNotNull(), F.struct(-F.length(text), order)))


def first_elements(records: DataFrame, key: str, order: Column, columns: dict[str, int | None]) -> DataFrame:
    """(key, *columns): of arrays of one type the distinct elements of a key in the order they are first met, at most so many.

    Elements are counted down to their first place before they are listed, so that what meets in one task is what a key has
    that is different, never all its rows.  For maps, pass arrays of their entries: the first entry of a map's key counts.
    """
    numbered = F.concat(*(F.transform(F.coalesce(F.col(c), F.array().cast(records.schema[c].dataType)), _place(i)) for i, c in enumerate(columns)))
    each = records.select(F.col(key).alias("__key"), order.alias("__order"), F.explode(numbered).alias("e")).select("__key", "__order", "e.*")
    entries = records.schema[next(iter(columns))].dataType.elementType
    by = F.col("v.key") if entries.typeName() == "struct" and entries.fieldNames() == ["key", "value"] else F.col("v")
    first = each.groupBy("__key", "column", by.alias("known")).agg(F.min(F.struct("__order", "place")).alias("at"), F.min_by("v", F.struct("__order", "place")).alias("v"))
    if any(columns.values()):
        most = F.coalesce(*(F.when(F.col("column") == i, F.lit(n)) for i, n in enumerate(columns.values()) if n), F.lit(2**31 - 1))
        rank = F.row_number().over(Window.partitionBy("__key", "column").orderBy("at"))
        first = first.withColumn("rank", rank).where(F.col("rank") <= most)
    of = lambda i: F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == i, F.struct("at", "v")))), lambda x: x["v"])
    return first.groupBy("__key").agg(*(of(i).alias(c) for i, c in enumerate(columns)))


def _place(i: int):
    return lambda v, at: F.struct(F.lit(i).alias("column"), at.alias("place"), v.alias("v"))


def merge_records(records: DataFrame, key: str, order: str, policy: dict[str, str]) -> DataFrame:
    """One row for each key, merged column by column.

    Policies: `first` (first non-empty), `last` (of the last row), `value` (first that is no placeholder), `longest`, `with:x` (what stands beside
    the longest x), `any`, `max` (0 is null), `map` (first of a key), `union` (arrays), `union:n` (the first n).  `order` makes every choice certain; give it no ties within a key.
    It may be a struct, such as a number and the row's place in its table (session.placed).
    """
    o = F.col(order)
    made: list[Column] = []
    listed: dict[str, dict[str, int | None]] = {}  # arrays and maps by type
    for name, rule in policy.items():
        c = F.col(name)
        if rule == "first":
            text = records.schema[name].dataType.typeName() == "string"
            filled = c.isNotNull() & (F.trim(c) != "") if text else c.isNotNull()
            made.append(first_where(c, filled, o).alias(name))
        elif rule == "value":
            made.append(first_where(c, ~is_placeholder(c), o).alias(name))
        elif rule == "longest":
            made.append(longest(c, o).alias(name))
        elif rule.startswith("with:"):  # the value that stands beside the longest text of another column
            other = F.col(rule.removeprefix("with:"))
            made.append(_beside_longest(c, other, o).alias(name))
        elif rule == "map":  # entries of all maps, the first of a key wins
            listed.setdefault(records.schema[name].dataType.simpleString(), {})[name] = None
        elif rule == "last":
            made.append(F.max_by(c, o).alias(name))
        elif rule == "any":
            made.append(F.coalesce(F.bool_or(c), F.lit(False)).alias(name))
        elif rule == "max":
            made.append(F.nullif(F.max(c), F.lit(0)).alias(name))
        else:
            _, _, most = rule.partition(":")
            listed.setdefault(records.schema[name].dataType.simpleString(), {})[name] = int(most) if most else None
    merged = records.groupBy(key).agg(*made, F.count(F.lit(1)).alias("merged"))
    for kind, columns in listed.items():
        as_map = kind.startswith("map")
        arrays = records.withColumns({c: F.map_entries(c) for c in columns}) if as_map else records
        found = first_elements(arrays, key, o, columns)
        filled = {c: F.coalesce(F.col(f"__found.{c}"), F.array().cast(arrays.schema[c].dataType)) for c in columns}
        joined = merged.join(found.alias("__found"), F.col(key).eqNullSafe(F.col("__found.__key")), "left")
        merged = joined.select(*(merged[c] for c in merged.columns), *((F.map_from_entries(v) if as_map else v).alias(c) for c, v in filled.items()))
    return merged.select(key, *policy, "merged")


def upsert(base: DataFrame, batch: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """base with the rows of batch (one for each key): one full outer join, no row of either is lost.

    Policies: `fill` (the new value unless it is null), `overwrite`, `union` (arrays), `replace` (a non-empty array),
    `keep` (set once at insert).  Adds `change`: inserted, updated or kept.
    """
    b, n = base.alias("b"), batch.alias("n")
    joined = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    here, there = F.col(f"b.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    out = [F.coalesce(f"b.{key}", f"n.{key}").alias(key)]
    for name, rule in policy.items():
        old, new = F.col(f"b.{name}"), F.col(f"n.{name}")
        none = F.array().cast(base.schema[name].dataType) if rule in ("union", "replace") else None
        if rule == "fill":
            merged = F.coalesce(new, old)
        elif rule == "overwrite":
            merged = new
        elif rule == "union":
            merged = F.array_union(F.coalesce(old, none), F.coalesce(new, none))
        elif rule == "replace":
            merged = F.when(F.size(F.coalesce(new, none)) > 0, new).otherwise(old)
        elif rule == "keep":
            merged = F.coalesce(old, new)
        else:
            raise ValueError(f"no policy {rule!r}")
        out.append(F.when(there & here, merged).when(there, new).otherwise(old).alias(name))
    return joined.select(*out, F.when(here & there, "updated").when(there, "inserted").otherwise("kept").alias("change"))


def sticky_language(old: Column, old_source: Column, new: Column) -> Column:
    """A language set by a person outlives every later ingest."""
    return F.when(old_source == "manual", old).otherwise(F.coalesce(new, old))


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def match_existing(batch: DataFrame, base: DataFrame) -> DataFrame:
    """batch with the id of the row it updates: by dedup_key, else by doi."""
    by_key = base.where("dedup_key is not null").select("dedup_key", F.col("id").alias("id_by_key"))
    by_doi = base.where("doi is not null").groupBy("doi").agg(F.min("id").alias("id_by_doi"))
    found = keyed_join(keyed_join(batch, by_key, "dedup_key"), by_doi, "doi")
    return found.withColumn("existing_id", F.coalesce("id_by_key", "id_by_doi")).drop("id_by_key", "id_by_doi")


def only_changed(rows: DataFrame, scored: DataFrame, key: str, context: str) -> DataFrame:
    """Rows whose content or context differs from what was scored: the work that is left."""
    content = F.xxhash64(*[c for c in rows.columns if c != key], F.lit(context))
    return rows.withColumn("content", content).join(scored.select(key, "content"), [key, "content"], "left_anti")


def discover_new(articles: DataFrame, known: DataFrame, research: Column) -> DataFrame:
    """Articles (source_key, article_id, dedup_key) with the reason they are taken or skipped: known, non-research,
    duplicate (of a stored row or an earlier article of the batch) or new."""
    seen = known.select("source_key", "article_id").distinct().withColumn("__known", F.lit(True))
    stored = known.select("dedup_key").where("dedup_key is not null").distinct().withColumn("__stored", F.lit(True))
    flagged = keyed_join(articles.withColumn("__research", F.coalesce(research, F.lit(False))).join(seen, ["source_key", "article_id"], "left"), stored, "dedup_key")
    open_ = F.col("__known").isNull() & F.col("__research") & F.col("__stored").isNull()
    first = flagged.where(open_).groupBy("dedup_key").agg(F.min("article_id").alias("__first"))
    found = keyed_join(flagged, first.where("dedup_key is not null"), "dedup_key")
    reason = F.when(F.col("__known").isNotNull(), "known").when(~F.col("__research"), "non-research").when(F.col("__stored").isNotNull() | (F.col("article_id") != F.col("__first")), "duplicate").otherwise("new")
    return found.withColumn("reason", reason).drop("__known", "__research", "__stored", "__first")


def sync_counts(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """How many rows of a batch are new, changed or the same as stored, by a hash of their content."""
    content = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != key])), 256).alias("content"))
    both = content(batch).join(content(base).withColumnRenamed("content", "old"), key, "left")
    return both.agg(F.count(F.lit(1)).alias("parsed"), F.count_if(F.col("old").isNull()).alias("inserted"), F.count_if(F.col("old") != F.col("content")).alias("updated"), F.count_if(F.col("old") == F.col("content")).alias("skipped"))


def restore_language(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows (id, auto_language) with the language in force: the last change of a person, unless that was to restore."""
    last = changes.groupBy("id").agg(F.max_by("language", F.struct("at", "ord")).alias("manual"))
    return rows.join(last, "id", "left").select("id", "auto_language", F.coalesce("manual", "auto_language").alias("language"), F.when(F.col("manual").isNotNull(), "manual").otherwise("auto").alias("language_source"))


#: How fields of records of one work are merged, how stored papers and rows of the stream of new work take new values.
MERGE_POLICY = {
    "doi": "first", "authors": "first", "issn": "first", "published_online": "first", "published_print": "first", "issued_date": "first", "language": "first", "keywords": "first",
    "title": "longest", "journal_name": "longest", "abstract": "longest", "abstract_source": "with:abstract", "volume": "value", "issue": "value", "pages": "value", "url": "value",
    "pdf_url": "value", "publisher": "value", "oa_status": "value", "license": "value", "open_access": "any", "citation_count": "max", "issn_list": "union", "sources": "union",
    "source_queries": "union:12", "topics": "union", "concepts": "union:8", "db_subjects": "union", "external_ids": "map",
}
PAPER_POLICY = {
    "doi": "fill", "journal_name": "fill", "issn": "fill", "abstract": "fill", "abstract_source": "fill", "published_online": "fill", "published_print": "fill", "issued_date": "fill",
    "volume": "fill", "issue": "fill", "pages": "fill", "url": "fill", "pdf_url": "fill", "oa_status": "fill", "license": "fill", "citation_count": "fill", "title": "overwrite",
    "authors": "overwrite", "open_access": "overwrite", "external_ids": "overwrite", "topic_scores": "overwrite", "status": "overwrite", "basis": "overwrite",
    "source_queries": "overwrite", "sources": "union", "topics": "union", "keywords": "replace", "db_topics": "replace", "db_subjects": "replace", "discovery_date": "keep",
}
STREAM_POLICY = {"title": "overwrite", "abstract": "overwrite", "authors": "overwrite", "published_date": "overwrite", "doc_type": "overwrite", "url": "overwrite", "first_seen": "keep", "matched_paper_id": "keep"}


def policy_for(rows: DataFrame, policy: dict[str, str]) -> dict[str, str]:
    """Of a policy what concerns the columns there are."""
    return {c: rule for c, rule in policy.items() if c in rows.columns}


def link_published(items: DataFrame, papers: DataFrame) -> DataFrame:
    """items (item_id, doi, title) with the paper that is their published version: by DOI, else by normalised title."""
    by_doi = papers.where("doi is not null").groupBy(normalize_doi(F.col("doi")).alias("__doi")).agg(F.min("id").alias("d")).where("__doi is not null")
    by_title = papers.groupBy(normalize_title(F.col("title")).alias("__title")).agg(F.min("id").alias("t")).where("__title <> ''")
    wanted = items.withColumn("__doi", normalize_doi(F.col("doi"))).withColumn("__title", F.nullif(normalize_title(F.col("title")), F.lit("")))
    found = keyed_join(keyed_join(wanted, by_doi, "__doi"), by_title, "__title")
    by = F.when(F.col("d").isNotNull(), "doi").when(F.col("t").isNotNull(), "title")
    return found.withColumn("matched_paper_id", F.coalesce("d", "t")).withColumn("matched_by", by).drop("__doi", "__title", "d", "t")


def add_by_doi(base: DataFrame, first: DataFrame, second: DataFrame, dois: DataFrame, key: str = "doi") -> DataFrame:
    """base with the records of both sources for the listed DOIs, merged field by field (the first source goes first)."""
    batch = first.withColumn("__ord", F.lit(0)).unionByName(second.withColumn("__ord", F.lit(1)), allowMissingColumns=True).withColumn(key, normalize_doi(F.col(key)))
    batch = batch.join(dois.select(normalize_doi(F.col(key)).alias(key)).distinct(), key, "left_semi")
    merged = merge_records(batch, key, "__ord", {c: r for c, r in policy_for(batch, MERGE_POLICY).items() if c != key}).drop("merged")
    return upsert(base, merged, key, {c: r for c, r in policy_for(base, PAPER_POLICY).items() if c in merged.columns and c != key})


def fill_keywords(papers: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """papers (id, doi, keywords, abstract) with keywords of a lookup (doi, ok, keywords, abstract), and one row of counts.

    Only papers with a DOI and no keywords are looked up; what is found replaces keywords unless it is empty and fills
    a missing abstract; a failed lookup is no paper without keywords.
    """
    other = found.select("doi", F.col("ok").alias("__ok"), F.col("keywords").alias("__keywords"), F.col("abstract").alias("__abstract"))
    joined = keyed_join(papers, other.where("doi is not null").dropDuplicates(["doi"]), "doi")
    due = F.col("doi").isNotNull() & (F.size(F.coalesce("keywords", F.array().cast("array<string>"))) == 0)
    got = due & F.coalesce("__ok", F.lit(False))
    some = F.size(F.coalesce("__keywords", F.array().cast("array<string>"))) > 0
    filled = joined.select(*(c for c in papers.columns if c not in ("keywords", "abstract")), F.when(got & some, F.col("__keywords")).otherwise(F.col("keywords")).alias("keywords"), F.when(got, F.coalesce("abstract", "__abstract")).otherwise(F.col("abstract")).alias("abstract"))
    counts = joined.agg(F.count_if(due).alias("checked"), F.count_if(got).alias("n_ok"), F.count_if(due & ~F.coalesce("__ok", F.lit(False))).alias("n_failed"), F.count_if(got & some).alias("with_keywords"), F.count_if(got & ~some).alias("without_keywords"))
    return filled, counts
