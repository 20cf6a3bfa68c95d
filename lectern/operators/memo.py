"""Values that are dear to compute, kept between runs by the hash of the row and of the context that they were made from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialize

PARTS = 64


@dataclass(frozen=True)
class Memoised:
    """The rows with their values, and how many distinct rows were computed, reused and forgotten."""

    rows: DataFrame
    computed: int
    reused: int
    forgotten: int


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A memo as it lies, or nothing."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files) else None


def memoise(rows: DataFrame, key: str, context: str, compute: Callable[[DataFrame], DataFrame], path: str, values: tuple[str, ...], parts: int = PARTS) -> Memoised:
    """rows with the columns `values` that `compute` adds, computed only for rows that the memo at `path` doesn't hold.

    A row is known by its key and the SHA-256 of all its columns; the memo is of use only in the same context (settings,
    lists, today).  Rows that are equal are computed once; rows without a key are rows like others.  The memo then holds
    just the rows of this run; only parts in which a row came, changed or went are written again.  What a run leaves behind
    when it fails midway are parts of either state, each true by itself, since a value stands under the hash of what it was made from.
    """
    spark = rows.sparkSession
    content = F.sha2(F.to_json(F.struct(F.lit(context).alias("__context"), *rows.columns), {"ignoreNullFields": "false"}), 256)
    part = F.pmod(F.xxhash64(F.col(key), F.lit(0)), F.lit(parts)).cast("int")
    hashed = rows.withColumns({"__content": content, "__part": part})
    # rows are told apart by their hashes; only those that are computed are shuffled as a whole, and once
    wanted = materialize(hashed.groupBy(F.col("__content").alias("content"), F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("n")), "wanted")
    old = stored(spark, path)
    missing = wanted if old is None else materialize(wanted.join(old.select("content", "part"), ["content", "part"], "left_anti"), "missing")
    hits = None if old is None else old.join(wanted.select("content", "part"), ["content", "part"], "left_semi")
    computed = missing.count()
    fresh = None
    if computed or hits is None:
        rest = hashed.join(missing.select(F.col("content").alias("__content"), F.col("n").alias("__n")), "__content").drop("__part")
        if missing.where("n > 1").limit(1).count():
            rest = rest.where("__n = 1").unionByName(rest.where("__n > 1").dropDuplicates(["__content"]))
        made = compute(rest.drop("__n"))
        fresh = materialize(made.select(F.col("__content").alias("content"), F.struct(*values).alias("values")).join(missing.select("content", "part"), "content"), "fresh")
    known = fresh if hits is None else hits.select("content", "part", "values") if fresh is None else hits.select("content", "part", "values").unionByName(fresh.select("content", "part", "values"))
    gone = 0 if hits is None else old.join(wanted.select("content", "part"), ["content", "part"], "left_anti").groupBy("part").count().collect()
    touched = {r.part for r in gone} if gone else set()
    if fresh is not None:
        touched |= {r.part for r in fresh.select("part").distinct().collect()}
    known = materialize(known, "known")  # the parts that are written are read for it
    if touched:
        mine = known.where(F.col("part").isin(sorted(touched)))
        mine.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        for empty in touched - {r.part for r in mine.select("part").distinct().collect()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={empty}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    reused = known.count() - computed
    found = hashed.join(known.select(F.col("content").alias("__content"), F.col("part").alias("__part"), "values"), ["__content", "__part"])
    return Memoised(found.select(*rows.columns, *(f"values.{v}" for v in values)), computed, reused, sum(r["count"] for r in gone) if gone else 0)
