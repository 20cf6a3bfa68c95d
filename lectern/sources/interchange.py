"""Moving a data set: export, import with new ids, citations as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def export_tables(tables: dict[str, DataFrame], path: str, secrets: tuple[str, ...] = ("api_key", "secret", "token")) -> None:
    for name, df in tables.items():
        df.drop(*secrets).write.mode("overwrite").parquet(f"{path}/{name}")


def id_map(local: DataFrame, incoming: DataFrame, key: Column) -> DataFrame:
    """(old_id, new_id, known): ids of incoming rows here: the local row of the same natural key, else a new id.

    New ids go on from the largest local one in order of old ids: a count within ranges of ids, and sums of the counts
    before, so that no task numbers them all.
    """
    here = local.select(key.alias("k"), F.col("id").alias("local_id")).where("k is not null").groupBy("k").agg(F.min("local_id").alias("local_id"))
    matched = incoming.select(F.col("id").alias("old_id"), key.alias("k")).join(here, "k", "left")
    top = local.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = matched.where("local_id is null").withColumn("block", F.floor(F.col("old_id") / 10_000))
    before = fresh.groupBy("block").count().withColumn("before", F.sum("count").over(Window.orderBy("block")) - F.col("count")).select("block", "before")
    numbered = fresh.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("old_id"))).join(before, "block").join(F.broadcast(top))
    known = matched.where("local_id is not null").select("old_id", F.col("local_id").alias("new_id"), F.lit(True).alias("known"))
    return known.unionByName(numbered.select("old_id", (F.col("top") + F.col("before") + F.col("n")).alias("new_id"), F.lit(False).alias("known")))


def remap_children(children: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Child rows under their parents' new ids; those whose parent wasn't imported go."""
    return children.join(ids.select(F.col("old_id").alias(column), "new_id"), column).drop(column).withColumnRenamed("new_id", column)


def import_preview(local: DataFrame, incoming: DataFrame, key: Column, most: int = 200_000) -> DataFrame:
    both = incoming.select(key.alias("k")).join(local.select(key.alias("k")).where("k is not null").distinct().withColumn("here", F.lit(True)), "k", "left")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if("here").alias("conflicts"), (F.count(F.lit(1)) <= most).alias("accepted"))


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[{}\\\r\n]+", " "))


def bibtex(key: Column, authors: Column, title: Column, journal: Column, year: Column, doi: Column) -> Column:
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), plain(c), F.lit("}")))
    body = F.concat_ws(",\n", line("author", F.array_join(authors, " and ")), line("title", title), line("journal", journal), line("year", year), line("doi", doi))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}"))


def ris(authors: Column, title: Column, journal: Column, year: Column, doi: Column) -> Column:
    line = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), plain(c)))
    names = F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), plain(a))), "\n")
    return F.concat_ws("\n", F.lit("TY  - JOUR"), F.nullif(names, F.lit("")), line("TI", title), line("JO", journal), line("PY", year), line("DO", doi), F.lit("ER  - "))


def csv_field(c: Column) -> Column:
    """A value as a field of a CSV line: in quotes, doubled inside, if it holds a quote, a comma or a line end."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame) -> Column:
    return F.concat_ws(",", *(csv_field(F.col(c)) for c in rows.columns))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
