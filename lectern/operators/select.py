"""Choosing a bounded list: ranks, quotas, never-repeating and diverse picks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import ship

TIERS = ("new", "catchup", "shown")


def rank_numbers(rows: DataFrame, group: str, score: str, ident: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(ident))))


def unseen(candidates: DataFrame, shown: DataFrame, ident: str) -> DataFrame:
    """Candidates that no earlier run has shown."""
    return candidates.join(shown.select(ident), ident, "left_anti")


def quota_pick(candidates: DataFrame, group: str, source: str, score: str, ident: str, limit: int, quota: int = 2) -> DataFrame:
    """For each group `limit` rows by score, at most `quota` of a source while others are left; ranked by score again."""
    best = [F.col(score).desc(), F.col(ident)]
    numbered = candidates.withColumn("__of_source", F.row_number().over(Window.partitionBy(group, source).orderBy(*best)))
    # of a source no more than `limit` can be taken, which bounds what meets in a group by its sources
    bounded = numbered.where(F.col("__of_source") <= limit)
    order = [(F.col("__of_source") > quota).cast("int"), *best]
    taken = bounded.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__place") <= limit)
    return taken.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*best))).drop("__of_source", "__place")


def first_per_journal(rows: DataFrame, journal: str, picked: Column, date: Column, ident: str, limit: int, today: str | None = None) -> DataFrame:
    """Each journal's newest row not yet picked (else its newest), then by recency, up to `limit` rows; stamped with the day."""
    within = Window.partitionBy(journal).orderBy(picked.cast("int"), date.desc(), F.col(ident))
    numbered = rows.withColumn("__n", F.row_number().over(within)).withColumn("__picked", picked)
    taken = numbered.orderBy((F.col("__n") > 1).cast("int"), F.col("__picked").cast("int"), date.desc(), F.col(ident)).limit(limit).drop("__n", "__picked")
    return taken.withColumn("last_picked", F.lit(today)) if today else taken


def greedy(pool: pd.DataFrame, categories: list[str], limit: int, penalty: float = 0.035, bonus: float = 0.10) -> pd.DataFrame:
    """Pick from one day's candidates, tier by tier: a few rounds give each category its best, then the best by score less
    a penalty for the rarest of its categories' counts plus a bonus for a language not yet in the tier."""
    counts, chosen = dict.fromkeys(categories, 0), []
    rows = pool.sort_values(["score", "id"], ascending=[False, True]).to_dict("records")
    for tier in TIERS:
        left = [r for r in rows if r["kind"] == tier]
        seen: set = set()

        def take(i: int) -> None:
            row = left.pop(i)  # noqa: B023
            seen.add(row["language"])  # noqa: B023
            for c in row["category_ids"]:
                counts[c] = counts.get(c, 0) + 1
            chosen.append(row)

        for turn in range(min(3, limit // 10)):
            for c in categories:
                if len(chosen) < limit and counts[c] <= turn:
                    i = next((i for i, r in enumerate(left) if c in r["category_ids"]), None)
                    if i is not None:
                        take(i)
        while left and len(chosen) < limit:
            value = [r["score"] - penalty * (min(counts.get(c, 0) for c in r["category_ids"]) if len(r["category_ids"]) else len(chosen)) + bonus * (r["language"] not in seen) for r in left]
            take(value.index(max(value)))
    return pd.DataFrame(chosen, columns=pool.columns).assign(rank=range(1, len(chosen) + 1))


def diverse_pick(candidates: DataFrame, day: str, categories: list[str], limit: int) -> DataFrame:
    """(day, id, kind, language, category_ids, score, rank): greedy() for each day.

    A candidate's worth depends only on its tier, categories, language and score, so the `limit` best of each such class
    hold every pick: no more than that meets in one task, however many candidates a day has.
    """
    rows = candidates.select(F.col(day).alias("day"), "id", "kind", "language", F.array_sort("category_ids").alias("category_ids"), "score")
    best = Window.partitionBy("day", "kind", "language", "category_ids").orderBy(F.col("score").desc(), "id")
    ship(candidates.sparkSession)
    pruned = rows.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= limit).drop("__n")
    schema = "day string, id long, kind string, language string, category_ids array<string>, score double, rank long"
    return pruned.groupBy("day").applyInPandas(lambda pool: greedy(pool, categories, limit), schema)


def missed_days(runs: DataFrame, date: str) -> DataFrame:
    """Each run with the days missed before it."""
    order = Window.orderBy("run_date")
    days = runs.select(F.col(date).cast("date").alias("run_date")).distinct()
    return days.withColumn("missed", F.greatest(F.datediff("run_date", F.lag("run_date").over(order)) - 1, F.lit(0)))


# --- runs of a day --------------------------------------------------------------------------------------------------


def days_due(days: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Days (run_date) without a good run (run_date, status), or all of them."""
    return days if force else days.join(runs.where("status = 'ok'").select("run_date"), "run_date", "left_anti")


def daily_items(candidates: DataFrame, days: DataFrame, shown: DataFrame, muted: DataFrame, limit: int) -> DataFrame:
    """(run_date, id, kind, score, rank) of each day that is due: the best candidates (run_date, id, discovery_date, language,
    score) that no earlier run has shown and nobody muted, in Chinese or English; new if found that day, else caught up.

    shown: (id, run_date) of all runs; an item shown on the day itself, by a run that is made again, may come again.
    """
    first = shown.groupBy("id").agg(F.min("run_date").alias("__first"))
    open_ = candidates.join(days.select("run_date"), "run_date").join(muted.select("id"), "id", "left_anti").join(first, "id", "left")
    fresh = open_.where((F.col("__first").isNull() | (F.col("__first") >= F.col("run_date"))) & F.col("language").isin("zh", "en"))
    kind = F.when(F.col("discovery_date") == F.col("run_date"), "new").otherwise("catchup")
    ranked = fresh.withColumn("kind", kind).withColumn("rank", F.row_number().over(Window.partitionBy("run_date").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= limit).select("run_date", "id", "kind", "score", "rank")


def run_rows(days: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each day: ok if anything was chosen, else empty; with its numbers of new and caught-up items."""
    counts = items.groupBy("run_date").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("kind") == "new").alias("n_new"))
    joined = days.join(counts, "run_date", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "n_new": F.coalesce("n_new", F.lit(0))})
    return joined.withColumn("status", F.when(F.col("items") > 0, "ok").otherwise("empty"))


def write_days(items: DataFrame, path: str) -> None:
    """Store items by day; a day that is made again replaces its own items and no other day's."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def frontier_picks(items: DataFrame, picked: DataFrame, today: str, size: int, newest: int = 2_000) -> DataFrame:
    """(id, source, score, rank, is_new) of the day's picks of new work: scored items (id, source, first_seen, score,
    n_directions) with a direction, not picked before, of the `newest` ones, two of a source while others are left."""
    scan = items.orderBy(F.col("first_seen").desc(), "id").limit(newest).where("n_directions > 0")
    fresh = unseen(scan, picked, "id").withColumn("day", F.lit(today))
    return quota_pick(fresh, "day", "source", "score", "id", size).select("id", "source", "score", "rank", (F.col("first_seen") == today).alias("is_new"))
