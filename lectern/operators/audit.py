"""Statistics about every step: sources, failures, catalogues, completeness, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.dates import is_naive, to_iso_utc


def ingest_health(log: DataFrame, by: str) -> DataFrame:
    """Requests, successes, failures, rows found and added, last time and success rate (three digits) of each source."""
    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum("found").alias("found"),
        F.sum("added").alias("added"), F.max("at").alias("last_at"), F.round(F.count_if("ok") / F.count(F.lit(1)), 3).alias("success_rate"),
    )


def source_state(log: DataFrame) -> DataFrame:
    """Of each source: the last check, the last success, the last status, rows added in all, first seen."""
    return log.groupBy("source").agg(
        F.max("at").alias("last_check"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"), F.max_by("status", F.struct("at", "id")).alias("last_status"),
        F.sum("added").alias("added"), F.min("at").alias("first_seen"),
    )


def failure_causes(log: DataFrame, cause: Column) -> DataFrame:
    """Of each source and cause the failures, the first of them, and how many came after an earlier one of the source's topic."""
    failed = log.where("not ok").withColumn("cause", cause)
    first = failed.groupBy("source", "topic").agg(F.min_by("cause", F.struct("at", "id")).alias("cause")).groupBy("source", "cause").agg(F.count(F.lit(1)).alias("firsts"))
    counts = failed.groupBy("source", "cause").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    return counts.join(first, ["source", "cause"], "left").select("source", "cause", "n", "first_at", (F.col("n") - F.coalesce("firsts", F.lit(0))).alias("retried"))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def catalog_coverage(entries: DataFrame) -> DataFrame:
    return entries.groupBy("catalog").agg(F.count_if("official").alias("n_official"), F.count_if(~F.col("official")).alias("n_reference"), F.countDistinct("journal_id").alias("journals"))


def completeness_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """How many rows there are, and how many have each of the columns."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))).alias(f"with_{c}") for c in columns))


def usage_by_day(log: DataFrame) -> DataFrame:
    day = F.date_format("at", "yyyy-MM-dd")
    return log.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("unknown"))


def duplicate_groups(rows: DataFrame, key: str, ident: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(ident).alias("keep")).where("n > 1")


def changed_rows(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """For each column the number of rows whose value differs between two versions of a table."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    return joined.agg(*(F.count_if(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(f"changed_{c}") for c in columns))


def distinct_tags(rows: DataFrame, tags: str) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).distinct()


def over_daily_cap(log: DataFrame, cap: int) -> DataFrame:
    day = F.date_format("at", "yyyy-MM-dd")
    return log.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("calls")).withColumn("allowed", F.col("calls") < cap)


def run_status(log: DataFrame, run: str) -> DataFrame:
    return log.groupBy(run).agg(F.when(F.bool_or("ok"), "ok").otherwise("partial").alias("status"), F.count_if(~F.col("ok")).alias("n_failed"))


def tail(log: DataFrame, limit: int, since: str | None = None, failures: bool = False) -> DataFrame:
    """The last rows of a log, the newest first; only failures, or those since a time, if so asked."""
    rows = log.where(~F.col("ok")) if failures else log
    rows = rows.where(F.col("at") >= F.lit(since).cast("timestamp")) if since else rows
    return rows.orderBy(F.col("at").desc(), F.col("id").desc()).limit(limit)


def log_rows(events: DataFrame, most: int = 500) -> DataFrame:
    """Rows of the ingest log (at, source, topic, ok, http_status, found, added, message, ms); a long message is cut."""
    return events.select("at", "source", "topic", "ok", "http_status", "found", "added", F.substring(F.coalesce("message", F.lit("")), 1, most).alias("message"), "ms")


def append_log(events: DataFrame, path: str) -> None:
    log_rows(events).write.mode("append").parquet(path)


def latest_run(runs: DataFrame, date: str = "run_date") -> DataFrame:
    """The run of the last day, the one of the highest id where a day has several: one row."""
    return runs.orderBy(F.col(date).desc(), F.col("run_id").desc()).limit(1)


def language_coverage(papers: DataFrame, selected: DataFrame, size: int) -> DataFrame:
    """One row: eligible rows by language, pending Chinese ones, selected ones by language, how many the list lacks."""
    lang = F.col("language")
    eligible, other = F.col("status") == "eligible", ~F.coalesce(lang.isin("zh", "en"), F.lit(False))
    have = papers.agg(F.count_if(eligible & (lang == "zh")).alias("zh_eligible"), F.count_if(eligible & (lang == "en")).alias("en_eligible"), F.count_if(eligible & other).alias("other_eligible"), F.count_if((F.col("status") == "pending") & (lang == "zh")).alias("zh_pending"))
    took = selected.agg(F.count_if(lang == "zh").alias("zh_selected"), F.count_if(lang == "en").alias("en_selected"), F.count_if(other).alias("other_selected"), F.greatest(F.lit(size) - F.count(F.lit(1)), F.lit(0)).alias("shortfall"))
    joined = have.join(F.broadcast(took))  # one row each
    return joined.withColumn("balanced", (F.col("zh_selected") > 0) & (F.col("en_selected") > 0))


def match_preview(matched: DataFrame) -> DataFrame:
    """Matched and unmatched rows of an import by the standing of their journals."""
    return matched.groupBy(F.col("journal_id").isNotNull().alias("matched"), "status").agg(F.count(F.lit(1)).alias("n"))


def stored_times(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """rows with values without an offset written as UTC instants, and one row of how many changed in each column."""
    fixed = {c: F.when(is_naive(F.col(c)), to_iso_utc(F.col(c))).otherwise(F.col(c)) for c in columns}
    return rows.withColumns(fixed), rows.agg(*(F.count_if(is_naive(F.col(c))).alias(f"changed_{c}") for c in columns))
