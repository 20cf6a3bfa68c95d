"""Loads that skip what they have read before, by a stored state of each landed file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.memo import stored
from lectern.session import materialize

STATE = "path string, length long, modified timestamp, digest string, batch int"


@dataclass(frozen=True)
class Synced:
    """What a load did: files seen, read anew since they differ, touched without a change, and gone; `batch` is its number."""

    files: int
    read: int
    touched: int
    gone: int
    batch: int


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, modified) of landed files; no file is opened for it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def state(spark: SparkSession, path: str) -> DataFrame:
    """The state as the last load left it: what the newest batch says of each file that it names."""
    rows = stored(spark, path)
    if rows is None:
        return spark.createDataFrame([], STATE)
    last = F.max_by(F.struct("length", "modified", "digest", "gone", "batch"), "batch").alias("last")
    return rows.groupBy("path").agg(last).select("path", "last.*").where("not gone").drop("gone")


def sync(spark: SparkSession, folder: str, state_path: str, apply: Callable[[list[str], int], None], pattern: str = "*", files_at_once: int = 10_000) -> Synced:
    """Hand the paths of new and changed files to `apply(paths, batch)`, and note their state once that is done.

    A file with the length and time that the state has is skipped without being opened; one with others is digested
    (SHA-256, one file a row, so files of at most 2 GB), and skipped if that is the same; only the others are handed over,
    `files_at_once` in a call.  The state is a log: a batch's rows are one write, made after `apply`, so a load that fails is made
    again, and `apply` must replace what it wrote under the batch's number.
    """
    known = state(spark, state_path)
    batch = (known.agg(F.max("batch")).first()[0] or 0) + 1
    seen = listing(spark, folder, pattern)
    old = known.select("path", F.col("length").alias("__length"), F.col("modified").alias("__modified"), F.col("digest").alias("__digest"))
    joined = seen.join(old, "path", "left")
    differs = materialize(joined.where(~(F.col("length").eqNullSafe(F.col("__length")) & F.col("modified").eqNullSafe(F.col("__modified")))), "differs")
    gone = materialize(known.join(seen.select("path"), "path", "left_anti"), "gone")
    files, n_gone = seen.count(), gone.count()
    n = differs.count()
    if not n and not n_gone:
        return Synced(files, 0, 0, 0, batch - 1)
    digested = gone.select("path", "length", "modified", "digest", F.lit(True).alias("gone"))
    changed: list[str] = []
    if n:
        paths = [r.path for r in differs.select("path").orderBy("path").toLocalIterator()]  # names alone
        told = None
        for at in range(0, n, files_at_once):
            part = spark.read.format("binaryFile").load(paths[at : at + files_at_once]).select("path", F.sha2("content", 256).alias("digest"))
            told = part if told is None else told.unionByName(part)
        told = materialize(told.join(differs, "path"), "digests")
        changed = [r.path for r in told.where("not digest <=> __digest").select("path").orderBy("path").toLocalIterator()]
        digested = digested.unionByName(told.select("path", "length", "modified", "digest", F.lit(False).alias("gone")))
        for at in range(0, len(changed), files_at_once):
            apply(changed[at : at + files_at_once], batch)
    digested.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(state_path)
    return Synced(files, len(changed), n - len(changed), n_gone, batch)
