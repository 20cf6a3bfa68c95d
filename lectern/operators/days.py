"""Runs of a day whose items and run row become visible together.

Items are stored under the name of their run, which nobody reads yet; the row of the run, one small file written last, makes
them visible.  Readers take the items of each day's last run; a run that failed before its row leaves the day as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.memo import stored
from lectern.operators.select import run_rows


def write_items(items: DataFrame, path: str) -> str:
    """Store the items (run_date and more) of a new run, still unseen; its name."""
    run = uuid.uuid4().hex
    items.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "run_date").parquet(f"{path}/items")
    return run


def publish(spark: SparkSession, days: DataFrame, path: str, run: str, at: str) -> None:
    """Write the run's row of each of its days (run_date), by what was stored: from then on the run is the days' last one.

    `at` orders runs of a day; runs of one time are ordered by name.  A day without items gets a row, too, and has none.
    """
    items = spark.read.parquet(f"{path}/items").where(F.col("run") == run) if stored(spark, f"{path}/items/run={run}") is not None else None
    own = days.select(F.col("run_date").cast("string")).distinct()
    counted = run_rows(own, items.select(F.col("run_date").cast("string"), "kind")) if items is not None else own.select("run_date", F.lit(0).cast("long").alias("items"), F.lit(0).cast("long").alias("n_new"), F.lit("empty").alias("status"))
    counted.withColumns({"run": F.lit(run), "at": F.lit(at)}).coalesce(1).write.mode("append").parquet(f"{path}/runs")


def commit(items: DataFrame, days: DataFrame, path: str, at: str) -> str:
    """Items and rows of the days of a run: all of them, or nothing that a reader sees."""
    run = write_items(items, path)
    publish(days.sparkSession, days, path, run, at)
    return run


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The row of each day's last run."""
    rows = spark.read.parquet(f"{path}/runs")
    last = F.max_by(F.struct(*(c for c in rows.columns if c != "run_date")), F.struct("at", "run"))
    return rows.groupBy("run_date").agg(last.alias("last")).select("run_date", "last.*")


def items(spark: SparkSession, path: str) -> DataFrame:
    """The items of each day's last run; their folders are chosen by the rows of runs, one a day, which is what is broadcast."""
    last = runs(spark, path).where("items > 0").select("run_date", "run")
    rows = spark.read.parquet(f"{path}/items").withColumn("run_date", F.col("run_date").cast("string"))
    return rows.join(last, ["run_date", "run"], "left_semi").drop("run")


def sweep(spark: SparkSession, path: str) -> int:
    """Delete items of runs that are no day's last one, failed ones too; how many.  Not beside a run that is being made."""
    kept = {r.run for r in runs(spark, path).where("items > 0").select("run").distinct().collect()}  # one a day at most
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/items")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("run=")]
    old = [p for p in found if p.getName().removeprefix("run=") not in kept]
    for p in old:
        files.delete(p, True)
    return len(old)
