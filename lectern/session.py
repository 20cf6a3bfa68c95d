"""Session helpers shared by the operators: tables, durable intermediate results."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []
_shipped: set[str] = set()


#: Tables with long texts, on which every row costs work.
_TEXTS = frozenset(("documents", "pages"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; texts that a scan would read in fewer pieces than there are cores are dealt over the cores.

    That concerns small inputs only (one file, one row group): a table of many files is read as it lies, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in _TEXTS and df.rdd.getNumPartitions() < cores else df


def placed(df: DataFrame) -> DataFrame:
    """A table as read, with `place`: the number of a row through all its files in the order of their names, with gaps, by which
    rows that are otherwise tied have an order."""
    at, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    if len(df.inputFiles()) < 2:
        return df.withColumn("place", at)
    names = sorted(r[0] for r in df.select(file).distinct().collect())
    numbers = df.sparkSession.createDataFrame([(f, n << 40) for n, f in enumerate(names)], "__file string, __first long")
    return df.withColumns({"__file": file, "__at": at}).join(F.broadcast(numbers), "__file").withColumn("place", F.col("__first") + F.col("__at")).drop("__file", "__first", "__at")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, spark.checkpoint.dir; a local one where that is unset and
    the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = _own[0]
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back; release() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as the session shuffles to, whatever their size.

    For a join that sorts much in a task: adaptive execution joins partitions by their compressed size, and rows that
    compress well are many times that once they are sorted.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(spark: SparkSession) -> int:
    """Delete what this application left in the shared folder (intermediate and landed tables, models), once the results made
    from it are stored; how many tables there were."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    n = len(files.listStatus(folder))
    files.delete(folder, True)
    return n


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for functions that run in Python workers there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ship-')}/lectern", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
