"""Calls of a model over a list of texts: at most so many a run, each text once, none twice whatever fails.

The work of a run is claimed before anything is called, and replies are stored under the digest of their text, so that another
run, or another row with the same text, takes what is there.  A task that Spark starts again can't know which of its calls
were made; it calls nothing and stores its rows as lost.  Claims without a reply, after a run that broke off, are lost, too.
Lost texts are called again only if a run is told so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.memo import stored
from lectern.session import ship

REPLIES = "digest string, status string, reply string, error string"


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """(digest, status, reply, error, run) of every text that was claimed: ok, failed, or lost; the last word on each."""
    said, claimed = stored(spark, f"{path}/replies"), stored(spark, f"{path}/claims")
    if claimed is None:
        return spark.createDataFrame([], f"{REPLIES}, run string")
    marks = claimed.select("digest", "at", "run", F.lit("lost").alias("status"), F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("said"))
    if said is not None:
        times = claimed.select("digest", "run", "at")
        marks = marks.unionByName(said.join(times, ["digest", "run"]).withColumn("said", F.lit(1)).select(*marks.columns))
    last = F.max_by(F.struct("status", "reply", "error", "run"), F.struct("at", "run", "said"))
    return marks.groupBy("digest").agg(last.alias("last")).select("digest", "last.*")


def _call(model: Callable[[list[str]], list[str]], at_once: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = TaskContext.get().attemptNumber() > 0
        for batch in batches:
            for at in range(0, len(batch), at_once):
                part = batch.iloc[at : at + at_once]
                texts, said, error = part["text"].tolist(), [None] * len(part), None
                if not again:
                    try:
                        said = [None if x is None else str(x) for x in model(texts)]
                        if len(said) != len(texts):
                            said, error = [None] * len(texts), f"{len(said)} replies to {len(texts)} texts"
                    except Exception as e:  # noqa: BLE001 - what a model raises is its reply
                        error = f"{type(e).__name__}: {e}"[:500]
                status = ["lost" if again else "failed" if error or x is None else "ok" for x in said]
                yield pd.DataFrame({"digest": part["digest"].tolist(), "status": status, "reply": pd.Series(said, dtype=object), "error": [error] * len(part)})

    return run


def claim(texts: DataFrame, path: str, limit: int, at: str, again: tuple[str, ...] = ()) -> str:
    """Claim the first `limit` texts (by priority, then digest) that have no reply, for a run; its name.

    texts: (text, priority long).  A text that several rows have is one, with its least priority; null and blank texts need
    no call.  `again` names statuses, of failed and lost, whose texts are called once more.
    """
    spark, run = texts.sparkSession, uuid.uuid4().hex
    wanted = texts.where(F.trim("text") != "").groupBy(digest_of(F.col("text")).alias("digest")).agg(F.min("priority").alias("priority"), F.first("text").alias("text"))
    done = replies(spark, path).where(~F.col("status").isin(*again)) if again else replies(spark, path)
    todo = wanted.join(done.select("digest"), "digest", "left_anti").orderBy("priority", "digest").limit(limit)
    todo.withColumns({"run": F.lit(run), "at": F.lit(at)}).write.mode("append").partitionBy("run").parquet(f"{path}/claims")
    return run


def call(spark: SparkSession, path: str, run: str, model: Callable[[list[str]], list[str]], tasks: int | None = None, at_once: int = 16) -> None:
    """Call the model for what a run has claimed, in `tasks` tasks (that of the cluster's cores) of `at_once` texts a call, and
    store what it says."""
    ship(spark)
    if stored(spark, f"{path}/claims/run={run}") is None:
        return
    claimed = spark.read.parquet(f"{path}/claims").where(F.col("run") == run).select("digest", "text")
    said = claimed.repartition(tasks or spark.sparkContext.defaultParallelism, "digest").mapInPandas(_call(model, at_once), REPLIES)
    said.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{path}/replies")


def work_through(texts: DataFrame, path: str, model: Callable[[list[str]], list[str]], limit: int, at: str, again: tuple[str, ...] = (), at_once: int = 16) -> DataFrame:
    """texts with (status, reply, error): one run of at most `limit` calls, and what earlier ones left; null where none was made.

    `at` orders runs.  Rows stay as they are, those with null or blank texts and those that no run has come to among them.
    """
    run = claim(texts, path, limit, at, again)
    call(texts.sparkSession, path, run, model, at_once=at_once)
    said = replies(texts.sparkSession, path).select(F.col("digest").alias("__digest"), "status", "reply", "error")
    return texts.withColumn("__digest", digest_of(F.col("text"))).join(said, "__digest", "left").drop("__digest")
