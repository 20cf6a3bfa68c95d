"""An ordered list stored by pages, so that a page far down costs what the first one does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialize

_ROW = 2**33  # rows of a partition in monotonically_increasing_id()


def ranked(rows: DataFrame, order: Sequence[Column], parts: int) -> DataFrame:
    """rows with `rank` (from 1) in a total order: sorted by range, numbered within each range, and moved up by the sizes of the
    ranges before it, which are `parts` numbers."""
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    split = materialize(placed, "ranges").withColumns({"__range": F.floor(F.col("__id") / _ROW).cast("int"), "__row": F.col("__id") % _ROW})
    before, starts = 0, []
    for r in sorted(split.groupBy("__range").count().collect(), key=lambda r: r["__range"]):
        starts += [F.lit(r["__range"]), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*starts), F.col("__range")) if starts else F.lit(0)
    return split.withColumn("rank", (start + F.col("__row") + 1).cast("long")).drop("__id", "__range", "__row")


def store_pages(rows: DataFrame, order: Sequence[Column], path: str, size: int, pages_of_folder: int = 100, parts: int = 64) -> int:
    """Write the list in its order, `size` rows a page and `pages_of_folder` pages a folder; how many pages there are (0: nothing is stored)."""
    numbered = ranked(rows, order, parts).withColumn("page", (F.floor((F.col("rank") - 1) / size) + 1).cast("long"))
    numbered = numbered.withColumn("folder", F.floor((F.col("page") - 1) / pages_of_folder).cast("long"))
    numbered.repartitionByRange(parts, "folder").sortWithinPartitions("folder", "rank").write.mode("overwrite").partitionBy("folder").parquet(path)
    return numbered.agg(F.max("page")).first()[0] or 0


def read_page(spark: SparkSession, path: str, number: int, pages_of_folder: int = 100) -> DataFrame:
    """One page, from the files of its folder alone; a page that is none has no rows."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("folder") == (number - 1) // pages_of_folder) & (F.col("page") == number)).orderBy("rank").drop("folder")
