"""Journals: catalogue rows, matching, precedence of official over reference entries, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.identifiers import normalize_issn, normalize_journal_name
from lectern.session import spread

#: What marks a catalogue row as a mere reference (fixed values).
REFERENCE = "待核验|未获|未完成|截图|参考|请勿|待查|pending|unverified|to be verified"


def is_reference(evidence: Column, notes: Column, mode: str = "auto") -> Column:
    if mode != "auto":
        return F.lit(mode == "force")
    return F.lower(F.concat_ws(" ", evidence, notes)).rlike(REFERENCE)


def index_databases(value: Column, catalog: Column) -> Column:
    """struct<databases, ssci>: an emerging-sources list never means SSCI; without a value the catalogue says."""
    listed = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[;；,，/|]"), lambda x: F.trim(x)), lambda x: x != "")
    ssci = F.when(catalog == "esci", False).when(F.size(listed) > 0, F.exists(listed, lambda x: F.upper(x).rlike("(^|[^A-Z])SSCI([^A-Z]|$)"))).otherwise(catalog.isin("ssci", "jcr"))
    return F.struct(listed.alias("databases"), ssci.alias("ssci"))


def keyed_join(rows: DataFrame, other: DataFrame, key: str, salts: int = 1024) -> DataFrame:
    """A left join on a key that many rows lack: those without it are dealt over `salts` parts instead of meeting in one task."""
    hashed = [c for c, t in rows.dtypes if "map<" not in t]
    salted = rows.withColumn("__salt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*hashed), F.lit(salts))).otherwise(0))
    plain = other.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(1)))  # 0, but no constant, which the optimizer would take out of the keys
    return salted.join(plain, [key, "__salt"], "left").drop("__salt").select(*rows.columns, *(c for c in other.columns if c != key))


def match_journals(rows: DataFrame, journals: DataFrame) -> DataFrame:
    """rows (row_id, issn, journal_name) with journal_id: by ISSN, else by name, else by a variant of the name.

    Among journals of one name those with an ISSN come first, then the smallest id.  Two equi-joins on keys, each made
    unique before, so that a common name doesn't multiply rows; names and variants are one table.
    """
    dealt = journals.select("journal_id", "issn", "name", "name_variants").repartition("journal_id")  # names cost work, and one task may read them all
    keys = dealt.withColumn("issn", normalize_issn(F.col("issn")))
    first = lambda c: F.coalesce(F.min(F.when(F.col("issn").isNotNull(), F.col(c))), F.min(c))
    by_issn = keys.where("issn is not null").groupBy("issn").agg(F.min("journal_id").alias("j1"))
    own = keys.select("issn", "name", F.col("journal_id").alias("own"), F.lit(None).cast(keys.schema["journal_id"].dataType).alias("other"))
    variants = keys.select("issn", F.explode("name_variants").alias("name"), F.lit(None).cast(keys.schema["journal_id"].dataType).alias("own"), F.col("journal_id").alias("other"))
    named = own.unionByName(variants).withColumn("name", normalize_journal_name(F.col("name"))).where("name <> ''")
    by_name = named.groupBy("name").agg(first("own").alias("j2"), first("other").alias("j3"))
    wanted = rows.withColumn("__issn", normalize_issn(F.col("issn"))).withColumn("__name", F.nullif(normalize_journal_name(F.col("journal_name")), F.lit("")))
    found = keyed_join(wanted, by_issn.withColumnRenamed("issn", "__issn"), "__issn")
    found = keyed_join(found, by_name.withColumnRenamed("name", "__name"), "__name")
    return found.withColumn("matched_by", F.when(F.col("j1").isNotNull(), "issn").when(F.col("j2").isNotNull(), "name").when(F.col("j3").isNotNull(), "variant").otherwise("none")).withColumn("journal_id", F.coalesce("j1", "j2", "j3")).drop("__issn", "__name", "j1", "j2", "j3")


#: Catalogues of SSCI journals, and the one that any other reference list replaces (fixed values).
SSCI_CATALOGS = ("ssci_list", "ssci_jcr")
REFERENCE_JCR = "ref_jcr"


def apply_entries(entries: DataFrame) -> DataFrame:
    """One entry for each (journal_id, catalog): official before reference, then the newer year, then the later load."""
    best = F.max_by(F.struct(*(c for c in entries.columns if c not in ("journal_id", "catalog"))), F.struct("official", F.coalesce("year", F.lit(0)), "load_ord"))
    return entries.groupBy("journal_id", "catalog").agg(best.alias("best")).select("journal_id", "catalog", "best.*")


def sibling_effects(entries: DataFrame) -> DataFrame:
    """What entries do to others of their journal: a later reference entry of another list removes the reference JCR entry,
    and an SSCI catalogue that says "not indexed" says so for the other SSCI catalogue too."""
    marks = entries.groupBy("journal_id").agg(
        F.max(F.when(~F.col("official") & (F.col("catalog") != REFERENCE_JCR), F.col("load_ord"))).alias("__reference"), F.max(F.when(F.col("catalog").isin(*SSCI_CATALOGS) & ~F.col("ssci_indexed"), F.col("load_ord"))).alias("__cleared"),
        F.max(F.when(F.col("catalog").isin(*SSCI_CATALOGS), F.col("load_ord"))).alias("__last"),
    )
    joined = apply_entries(entries).join(marks, "journal_id")
    kept = joined.where((F.col("catalog") != REFERENCE_JCR) | F.col("__reference").isNull() | (F.col("__reference") < F.col("load_ord")))
    cleared = F.col("catalog").isin(*SSCI_CATALOGS) & (F.col("__cleared") >= F.col("load_ord"))
    return kept.withColumn("ssci_indexed", F.when(F.coalesce(cleared, F.lit(False)), False).otherwise(F.col("ssci_indexed"))).drop("__reference", "__cleared", "__last")


def may_overwrite(official: Column, year: Column, old_official: Column, old_year: Column) -> Column:
    """Whether an incoming rank replaces the stored one (null if none): an official one always, a reference one never an
    official one, and another reference one unless it is older."""
    return old_official.isNull() | official | (~old_official & (F.coalesce(year, F.lit(0)) >= F.coalesce(old_year, F.lit(0))))


def best_entry(entries: DataFrame, value: str) -> DataFrame:
    """For each journal the value of its best entry: official first, then the newest year."""
    return entries.where(F.col(value).isNotNull()).groupBy("journal_id").agg(F.max_by(value, F.struct("official", F.coalesce("year", F.lit(0)), "load_ord")).alias(value))


def eligibility(language: Column, has_journal: Column, blacklisted: Column, zh_official: Column, zh_reference: Column, ssci: Column, esci_only: Column, quartile: Column, zone: Column, en_reference: Column) -> Column:
    """struct<status, basis>: Chinese journals by official lists, English ones by SSCI with Q1-Q3 or zone 1-3."""
    of = lambda s, b: F.struct(F.lit(s).alias("status"), F.lit(b).alias("basis"))
    ranked = F.coalesce(quartile.isin("Q1", "Q2", "Q3"), F.lit(False)) | F.coalesce(zone.between(1, 3), F.lit(False))
    return (
        F.when(~has_journal, of("pending", "none"))
        .when(blacklisted, of("excluded", "blacklist"))
        .when((language == "zh") & zh_official, of("eligible", "official"))
        .when((language == "zh") & zh_reference, of("reference", "reference"))
        .when((language == "en") & ssci & ~esci_only & ranked, of("eligible", "official"))
        .when((language == "en") & en_reference, of("reference", "reference"))
        .otherwise(of("pending", "unverified"))
    )


def merge_duplicate_journals(journals: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(journal_id -> keeper), the merged journals and their entries: of each clean name the row with the most to lose is kept.

    The keeper takes an ISSN of any of them, the union of their entries (one for each catalogue and edition, official
    first), the official or newest rank, and a flag that any has; flags of journals: verified, ssci_confirmed.
    """
    named = journals.withColumn("clean", normalize_journal_name(F.col("name")))
    size = entries.groupBy("journal_id").agg(F.countDistinct("catalog").alias("n_cats"), F.bool_or("official").alias("official"))
    score = F.when(F.col("issn").isNotNull(), 1000).otherwise(0) + F.when(F.coalesce("official", F.lit(False)), 500).otherwise(0) + 10 * F.coalesce("n_cats", F.lit(0))
    scored = named.join(size, "journal_id", "left").withColumn("score", score)
    flags = [F.bool_or(c).alias(c) for c in ("verified", "ssci_confirmed") if c in journals.columns]
    keeper = scored.where("clean <> ''").groupBy("clean").agg(F.max_by("journal_id", F.struct("score", (-F.col("journal_id")))).alias("keeper"), F.count(F.lit(1)).alias("n"), F.max("issn").alias("any_issn"), *flags)
    links = scored.join(keeper.select("clean", "keeper"), "clean").select("journal_id", "keeper")
    plain = scored.drop("verified", "ssci_confirmed")
    merged = plain.join(keeper, (plain.clean == keeper.clean) & (plain.journal_id == keeper.keeper)).select("journal_id", "name", F.coalesce("issn", "any_issn").alias("issn"), F.col("n").alias("merged"), *(c for c in ("verified", "ssci_confirmed") if c in journals.columns))
    moved = entries.join(links, "journal_id").withColumn("journal_id", F.col("keeper")).drop("keeper")
    keys = [c for c in ("journal_id", "catalog", "edition") if c in moved.columns]
    best = F.max_by(F.struct(*(c for c in moved.columns if c not in keys)), F.struct("official", *([F.coalesce("year", F.lit(0))] if "year" in moved.columns else []), *(["load_ord"] if "load_ord" in moved.columns else [])))
    return links, merged, moved.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def confirm_ssci(journals: DataFrame, issns: DataFrame, value: bool = True) -> DataFrame:
    """journals with ssci_confirmed set for the listed ISSNs, and whether that changed it."""
    listed = issns.select(normalize_issn(F.col("issn")).alias("__issn")).where("__issn is not null").distinct().withColumn("__listed", F.lit(True))
    joined = journals.join(listed, normalize_issn(F.col("issn")) == F.col("__issn"), "left")
    new = F.when(F.col("__listed"), F.lit(value)).otherwise(F.col("ssci_confirmed"))
    return joined.withColumn("changed", ~new.eqNullSafe(F.col("ssci_confirmed"))).withColumn("ssci_confirmed", new).drop("__issn", "__listed")


def catalog_entry(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Catalogue rows under their canonical names: a header counts if it equals an alias without case, spaces and signs."""
    import re

    clean = lambda h: re.sub(r"[\s_\-（）()]", "", h.lstrip("﻿")).lower()
    have = {clean(c): c for c in rows.columns}
    picked = {name: next((have[clean(a)] for a in options if clean(a) in have), None) for name, options in aliases.items()}
    filled = [F.col(f"`{c}`") for c in picked.values() if c]
    kept = rows.where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in filled]).isNotNull()) if filled else rows
    return kept.select(*((F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(name) for name, c in picked.items()))



# --- verdicts from entries ------------------------------------------------------------------------------------------


def journal_evidence(entries: DataFrame, accept_extended: bool = False) -> DataFrame:
    """Of each journal_id what its entries (catalog, official, ssci_indexed, quartiles, zone) amount to.

    Columns: zh_official, zh_reference, ssci, ssci_reference, esci_only, ranked (official quartile 1-3), ranked_reference,
    zoned (zone 1-3), verified, tags (array<struct<type, kind>>, of each catalogue once, sorted).
    """
    c, official, reference = F.col("catalog"), F.col("official"), ~F.col("official")
    ranked = F.coalesce(F.exists("quartiles", lambda q: q.isin("Q1", "Q2", "Q3")), F.lit(False))
    some = lambda condition, name: F.bool_or(F.coalesce(condition, F.lit(False))).alias(name)
    extended = F.lit(accept_extended)
    return entries.groupBy("journal_id").agg(
        some(official & (c.isin("cssci", "cn_core") | ((c == "cssci_ext") & extended)), "zh_official"), some(reference & (c.isin("cssci", "ref_cssci") | ((c == "ref_cssci_ext") & extended)), "zh_reference"),
        some(official & c.isin(*SSCI_CATALOGS) & F.coalesce("ssci_indexed", F.lit(True)), "ssci"), some(reference & c.isin(*SSCI_CATALOGS, "ref_jcr", "ref_ssci"), "ssci_reference"),
        (F.bool_or(c == "ref_esci") & ~F.bool_or(c.isin(*SSCI_CATALOGS, "ref_ssci", "ref_jcr"))).alias("esci_only"), some(official & (c == "ssci_jcr") & ranked, "ranked"),
        some(reference & ranked, "ranked_reference"), some(F.col("zone").between(1, 3), "zoned"), some(official, "verified"),
        F.array_sort(F.collect_set(F.struct(c.alias("type"), F.when(official, "official").otherwise("reference").alias("kind")))).alias("tags"),
    )


def verdict(language: Column, has_journal: Column, blacklisted: Column, e: Column) -> Column:
    """struct<status, basis, missing> of a journal with evidence `e` (journal_evidence() as a struct, null if none)."""
    is_ = lambda name: F.coalesce(e[name], F.lit(False))
    zh = language == "zh"
    official = F.when(zh, is_("zh_official")).otherwise(is_("ssci") & (is_("ranked") | is_("zoned")))
    reference = F.when(zh, is_("zh_reference")).otherwise(~is_("esci_only") & ((is_("ranked_reference") & (is_("ssci_reference") | is_("ssci"))) | (is_("zoned") & is_("ssci_reference"))))
    of = lambda status, basis, missing: F.struct(F.lit(status).alias("status"), F.lit(basis).alias("basis"), missing.alias("missing"))
    none = F.lit(None).cast("string")
    lacks = F.when(zh, "chinese list").when(is_("esci_only"), "emerging list only").when(~is_("ssci"), "ssci").otherwise("rank")
    return (
        F.when(~has_journal, of("pending", "pending", F.lit("journal")))
        .when(blacklisted, of("excluded", "excluded", none))
        .when(official, of("eligible", "official", none))
        .when(reference, of("reference", "reference", F.lit("official list")))
        .otherwise(of("pending", "pending", lacks))
    )


#: Headlines of a paper's standing (fixed values).
HEADLINES = {"official": "期刊条件合格（官方目录已核验）", "reference": "参考候选：期刊信息来自非官方参考线索，尚未核验", "pending": "待核验：该刊未在已导入的官方目录中匹配到"}


def verification_label(status: Column, basis: Column, tags: Column) -> Column:
    """struct<status, official, headline, evidence>: only an official verdict may say so; evidence are the tags of its kind."""
    kind = F.when((status == "eligible") & (basis == "official"), "official").when(status == "reference", "reference").otherwise("pending")
    headline = F.element_at(F.create_map(*(F.lit(x) for pair in HEADLINES.items() for x in pair)), kind)
    evidence = F.coalesce(F.filter(tags, lambda t: t["kind"] == kind), F.array().cast("array<struct<type:string,kind:string>>"))
    return F.struct(kind.alias("status"), (kind == "official").alias("official"), headline.alias("headline"), evidence.alias("evidence"))


#: Beginnings of the notes on a journal's standing (fixed values).
NOTES = {"eligible": "期刊条件满足（官方目录已核验）：", "reference": "参考候选（非官方目录）：", "pending": "期刊条件暂不能确认：", "excluded": "该刊在你的排除名单中，不会进入简报。"}


def note_of(status: Column, missing: Column) -> Column:
    """The note that tells a standing and what is missing for more."""
    begin = F.element_at(F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair)), status)
    return F.concat(begin, F.coalesce(missing, F.lit("")))


def refresh_notes(judged: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, note, changed) of papers judged anew beside the notes they have (id, note), and one row with how many change."""
    made = spread(judged.select("id", "status", "missing"), "id").join(spread(notes.select("id", F.col("note").alias("__old")), "id"), "id", "left")
    rows = made.withColumn("note", note_of(F.col("status"), F.col("missing"))).select("id", "note", (~F.col("note").eqNullSafe(F.col("__old"))).alias("changed"))
    return rows, rows.agg(F.count(F.lit(1)).alias("papers"), F.count_if("changed").alias("changed"))


def changed_since(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """snapshots (paper_id, status) of a past run with whether a paper's standing is another one now."""
    now = current.select(F.col("id").alias("paper_id"), F.col("status").alias("now"))
    return spread(snapshots, "paper_id").join(spread(now, "paper_id"), "paper_id", "left").withColumn("changed", ~F.col("status").eqNullSafe(F.col("now")))


def reconcile_flags(journals: DataFrame, evidence: DataFrame) -> DataFrame:
    """journals with verified and ssci_confirmed as their entries have them, and whether that changes a row."""
    joined = journals.join(evidence.select("journal_id", F.col("verified").alias("__v"), F.col("ssci").alias("__s")), "journal_id", "left")
    new = {"verified": F.coalesce("__v", F.lit(False)), "ssci_confirmed": F.coalesce("__s", F.lit(False))}
    changed = ~(new["verified"].eqNullSafe(F.col("verified")) & new["ssci_confirmed"].eqNullSafe(F.col("ssci_confirmed")))
    return joined.withColumn("changed", changed).withColumns(new).drop("__v", "__s")


def judged(papers: DataFrame, journals: DataFrame, entries: DataFrame, accept_extended: bool = False) -> DataFrame:
    """papers (id, issn, journal_name, language, status) with old_status, journal_id, matched_by, status, basis and missing made anew.

    journals: journal_id, name, issn, name_variants, blacklisted.  One pass: match journals, sum up entries, judge.
    """
    matched = match_journals(papers.withColumnRenamed("status", "old_status").drop("journal_id").withColumnRenamed("id", "row_id"), journals).withColumnRenamed("row_id", "id")
    found = journal_evidence(entries, accept_extended)
    side = journals.select("journal_id", "blacklisted").join(found.select("journal_id", F.struct(*(c for c in found.columns if c != "journal_id")).alias("evidence")), "journal_id", "left")
    joined = keyed_join(matched, side, "journal_id")
    v = verdict(F.col("language"), F.col("journal_id").isNotNull(), F.coalesce("blacklisted", F.lit(False)), F.col("evidence"))
    return joined.withColumn("v", v).select("id", "issn", "journal_name", "journal_id", "matched_by", "language", "old_status", "v.*")


def revalidate(papers: DataFrame, journals: DataFrame, entries: DataFrame, accept_extended: bool = False) -> DataFrame:
    """papers (id, issn, journal_name, language, status) with journal_id, status, basis and missing made anew, and what changed."""
    found = judged(papers, journals, entries, accept_extended).drop("issn", "journal_name")
    return found.withColumn("changed", ~F.col("status").eqNullSafe(F.col("old_status")))


def revalidation_counts(revalidated: DataFrame) -> DataFrame:
    """One row: papers linked to a journal, by standing, and changed."""
    status = lambda x: F.count_if(F.col("status") == x).alias(f"n_{x}")
    return revalidated.agg(F.count(F.lit(1)).alias("papers"), F.count("journal_id").alias("linked"), *map(status, ("eligible", "reference", "pending", "excluded")), F.count_if("changed").alias("changed"))


def seed_journals(journals: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds that are no journal yet, names to add to known ones), by ISSN; bundled entries are reference entries always."""
    known = journals.select(normalize_issn(F.col("issn")).alias("__issn"), "journal_id", F.col("name").alias("__name")).where("__issn is not null")
    joined = keyed_join(seeds.withColumn("__issn", normalize_issn(F.col("issn"))), known, "__issn")
    missing = joined.where("journal_id is null").select(*seeds.columns)
    variants = joined.where((F.col("journal_id").isNotNull()) & (F.lower("name") != F.lower("__name"))).select("journal_id", F.col("name").alias("variant")).distinct()
    return missing, variants


def load_registry(loads: DataFrame) -> DataFrame:
    """Of each catalogue its last load (edition, rows, at) and how many there were, from a log of loads."""
    return loads.groupBy("catalog").agg(F.max_by(F.struct("edition", "rows", "at"), F.struct("at", "load_id")).alias("last"), F.count(F.lit(1)).alias("loads")).select("catalog", "last.*", "loads")
