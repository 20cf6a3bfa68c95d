"""Verdicts of stored papers brought up to date after some journals changed, without a look at the others.

Papers are stored in parts by the key that finds their journal first (ISSN, else name).  A paper's journal can change only if one
of the paper's keys is a key of a changed journal, as it was or as it is: those keys name the parts that are read.  A paper
that lies in the part of its ISSN but may match by name is found through `homes`, a small table of the parts in which names
occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.identifiers import normalize_issn, normalize_journal_name
from lectern.operators.journals import judged
from lectern.session import materialize

PARTS = 256
KEPT = ("id", "issn", "journal_name", "language", "status", "journal_id", "basis", "missing")


def _issn() -> Column:
    return normalize_issn(F.col("issn"))


def _name() -> Column:
    return F.nullif(normalize_journal_name(F.col("journal_name")), F.lit(""))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _home(parts: int) -> Column:
    """The part of a paper; papers without any key, which no journal's change concerns, are dealt by id."""
    return F.when(F.coalesce(_issn(), _name()).isNotNull(), _part(F.coalesce(_issn(), _name()), parts)).otherwise(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def judge(papers: DataFrame, journals: DataFrame, entries: DataFrame) -> DataFrame:
    """papers (id, issn, journal_name, language, status) with journal_id, status, basis and missing by journals.judged()."""
    return judged(papers.select("id", "issn", "journal_name", "language", "status"), journals, entries).select(*KEPT)


def store(judged: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write judged papers by part, and the homes of their names."""
    placed = judged.select(*KEPT, _home(parts).alias("part"))
    placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/papers")
    names = judged.sparkSession.read.parquet(f"{path}/papers").select("journal_name", F.col("part").alias("home")).distinct()
    homes = names.select(_name().alias("name"), "home").where("name is not null").distinct()
    homes.withColumn("part", _part(F.col("name"), parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/homes")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/papers")


def keys_of(journals: DataFrame, changed: DataFrame) -> DataFrame:
    """(kind, key): every ISSN, name and variant of the changed journals (journal_id), in one version of the journals."""
    own = journals.join(changed.select("journal_id"), "journal_id", "left_semi")
    names = own.select(F.explode(F.concat(F.array("name"), F.coalesce("name_variants", F.array().cast("array<string>")))).alias("n"))
    by_name = names.select(F.lit("name").alias("kind"), normalize_journal_name(F.col("n")).alias("key")).where("key <> ''")
    return own.select(F.lit("issn").alias("kind"), _issn().alias("key")).where("key is not null").unionByName(by_name).distinct()


def changed_journals(old: DataFrame, new: DataFrame, old_entries: DataFrame, new_entries: DataFrame) -> DataFrame:
    """journal_id of journals that came, went, or differ in a column or an entry between two versions."""
    whole = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != "journal_id")), {"ignoreNullFields": "false"}), 256)
    rows = lambda df: df.select("journal_id", whole(df).alias("h"))
    lists = lambda df: rows(df).groupBy("journal_id").agg(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    differ = lambda a, b, on: a.join(b, on, "left_anti").select("journal_id").unionByName(b.join(a, on, "left_anti").select("journal_id"))
    return differ(rows(old), rows(new), ["journal_id", "h"]).unionByName(differ(lists(old_entries), lists(new_entries), ["journal_id", "h", "n"])).distinct()


def affected_parts(spark: SparkSession, path: str, keys: DataFrame, parts: int = PARTS) -> list[int]:
    """Parts that hold a paper with one of the keys, at most `parts` numbers."""
    held = materialize(keys.withColumn("part", _part(F.col("key"), parts)), "keys")
    own = {r.part for r in held.select("part").distinct().collect()}
    if not own:
        return []
    homes = spark.read.parquet(f"{path}/homes").where(F.col("part").isin(sorted(own)))
    return sorted(own | {r.home for r in homes.join(held.where("kind = 'name'").select(F.col("key").alias("name")), "name", "left_semi").select("home").distinct().collect()})


def affected(spark: SparkSession, path: str, keys: DataFrame, parts: int = PARTS) -> DataFrame:
    """Stored papers with one of the keys (kind, key), read from their parts alone."""
    held = materialize(keys.distinct(), "keys")
    near = load(spark, path).where(F.col("part").isin(affected_parts(spark, path, held, parts)))
    one = lambda kind: held.where(F.col("kind") == kind).select(F.col("key").alias(f"__{kind}"))
    marked = near.withColumns({"__issn": _issn(), "__name": _name()})
    by_issn = marked.join(one("issn"), "__issn", "left_semi").select("id")
    by_name = marked.join(one("name"), "__name", "left_semi").select("id")
    return near.join(by_issn.union(by_name).distinct(), "id", "left_semi")


def revalidate_changed(spark: SparkSession, path: str, old: DataFrame, new: DataFrame, old_entries: DataFrame, new_entries: DataFrame, parts: int = PARTS) -> DataFrame:
    """Judge anew the stored papers that the differences between two versions of journals and entries concern, and replace
    their parts; the papers that were looked at (id, status, old_status, changed).

    The table then equals one that is judged as a whole.  `parts` is that of store().
    """
    changed = materialize(changed_journals(old, new, old_entries, new_entries), "changed")
    keys = keys_of(old, changed).unionByName(keys_of(new, changed)).distinct()
    papers = materialize(affected(spark, path, keys, parts), "affected")
    fresh = materialize(judge(papers, new, new_entries).join(papers.select("id", "part", F.col("status").alias("old_status")), "id"), "fresh")
    touched = [r.part for r in fresh.select("part").distinct().collect()]
    if touched:
        others = load(spark, path).where(F.col("part").isin(touched)).join(fresh.select("id"), "id", "left_anti")
        whole = materialize(others.select(*KEPT, "part").unionByName(fresh.select(*KEPT, "part")), "parts")
        whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/papers")
    return fresh.select("id", "status", "old_status", (~F.col("status").eqNullSafe(F.col("old_status"))).alias("changed"))
