"""The same merges and upserts on streams of landed files, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.merge import merge_records, upsert
from lectern.session import materialize

PARTS = 64


def keyed_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of stream_upserts(), a plain partitioned Parquet folder; empty if nothing was written yet."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema).withColumn("part", F.lit(0))
    return spark.read.parquet(path)


def stream_upserts(records: DataFrame, path: str, key: str, order: str, merge: dict[str, str], policy: dict[str, str], checkpoint: str, parts: int = PARTS, mode: str = "append") -> StreamingQuery:
    """Merge each micro-batch by key and upsert it into a table that is partitioned by a hash of the key.

    A batch reads and replaces only the partitions that its keys fall into (dynamic partition overwrite); the new rows are
    stored apart first, so that a batch that fails leaves the table as it was and one that is run again gives the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        merged = merge_records(batch, key, order, merge).drop("merged")
        spark = batch.sparkSession
        merged = materialize(merged.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "batch")
        touched = [r.part for r in merged.select("part").distinct().collect()]  # at most `parts`
        base = keyed_table(spark, path, merged.drop("part").schema).where(F.col("part").isin(touched)) if touched else None
        if base is None:
            return
        new = upsert(base.drop("part"), merged.drop("part"), key, policy).drop("change")
        stored = materialize(new.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "upserted")
        stored.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return records.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_health(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests and failures of each source and day, once the day is `late` behind the newest row."""
    return log.withWatermark("at", late).groupBy(F.window("at", "1 day"), "source").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("n_failed"))
