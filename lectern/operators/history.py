"""A log of actions and undos, and what holds at any of its steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ship

_DECIDED = "owner string, seq long, action_id long, undo_of long, kind string, outcome string"


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of an owner come together, in order; what is kept of one are the actions that can still be undone."""
    owner: object = None
    live: dict[int, tuple[str, list[str]]] = {}
    last: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        kinds, outcomes = [], []
        for who, action, undo_of, kind, subjects in zip(batch["owner"], batch["action_id"], batch["undo_of"], batch["kind"], batch["subjects"], strict=True):
            if who != owner:
                owner, live, last = who, {}, {}
            if pd.isna(undo_of):
                own = list(dict.fromkeys(x for x in (subjects if subjects is not None else ()) if x is not None))
                if action in live or not own:
                    outcomes.append("refused")
                else:
                    live[action] = kind, own
                    for x in own:
                        last.setdefault((kind, x), []).append(action)
                    outcomes.append("done")
                kinds.append(kind)
                continue
            target = int(undo_of)
            kind, own = live.get(target, (None, []))
            kinds.append(kind)
            if not own:
                outcomes.append("gone")
            elif any(last[kind, x][-1] != target for x in own):
                outcomes.append("later action")
            else:
                for x in own:
                    last[kind, x].pop()
                del live[target]
                outcomes.append("undone")
        yield pd.DataFrame({"owner": batch["owner"], "seq": batch["seq"], "action_id": batch["action_id"], "undo_of": batch["undo_of"].astype("Int64"), "kind": kinds, "outcome": outcomes})


def decide(log: DataFrame) -> DataFrame:
    """(owner, seq, action_id, undo_of, kind, outcome) of every row of a log (owner, seq, action_id, undo_of, kind, subjects, value).

    An action does something of one kind to some subjects; an undo (undo_of) takes an action back, unless that was taken
    back before (`gone`) or a later action of its kind, still in force, has one of its subjects (`later action`).  An
    action without subjects, or under a number that is in force, is `refused`.  An owner's rows are folded in order of
    `seq` as they stream by: they are one task's, since each may hang on all before; owners are dealt over all tasks.
    """
    ship(log.sparkSession)
    dealt = log.select(F.col("owner").cast("string"), F.col("seq").cast("long"), F.col("action_id").cast("long"), F.col("undo_of").cast("long"), "kind", F.col("subjects").cast("array<string>"))
    return dealt.repartition("owner").sortWithinPartitions("owner", "seq").mapInPandas(_decide, _DECIDED)


def as_of(log: DataFrame, decided: DataFrame, at: int | None = None) -> DataFrame:
    """(owner, kind, subject, value, seq) in force after step `at` (the end): of the actions that were done and not undone by
    then, the last of each subject.  A subject without one is as it was before all of them, and has no row."""
    until = F.lit(True) if at is None else F.col("seq") <= at
    undone = decided.where(until & (F.col("outcome") == "undone")).select("owner", F.col("undo_of").alias("action_id"), F.col("seq").alias("__undone"))
    done = decided.where(until & (F.col("outcome") == "done")).select("owner", "seq", "action_id")
    # a number may be used again once it is free: an undo takes back the last action of its number before it
    taken = done.join(undone, ["owner", "action_id"]).where("__undone > seq").groupBy("owner", "action_id", "__undone").agg(F.max("seq").alias("seq")).select("owner", "seq")
    live = done.join(taken, ["owner", "seq"], "left_anti")
    rows = log.select(F.col("owner").cast("string"), F.col("seq").cast("long"), "kind", F.explode(F.array_distinct(F.col("subjects").cast("array<string>"))).alias("subject"), "value").where("subject is not null")
    return rows.join(live.select("owner", "seq"), ["owner", "seq"]).groupBy("owner", "kind", "subject").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
