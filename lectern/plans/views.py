"""Bibliographic views of the test tables, as DataFrames and, for the SQL beside each query, as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import spread, table

TODAY = "2001-08-02"

PAPERS_SQL = """
p AS (SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, d.lang AS language, d.source AS source,
  strftime(o.o_orderdate, '%Y-%m-%d') AS discovery_date, o.o_orderstatus AS status, o.o_orderpriority AS priority, o.o_custkey AS journal_id,
  CAST(floor(o.o_totalprice) AS BIGINT) AS citation_count
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id)"""
LOG_SQL = """
g AS (SELECT event_id AS id, ts AS "at", event_type AS source, user_id % 7 AS topic, event_type <> 'error' AS ok, event_type AS status,
  CAST(floor(value) AS BIGINT) AS found, CAST(floor(value / 10) AS BIGINT) AS added, props FROM events)"""
JUDGED_SQL = "j AS (SELECT doc_id AS paper_id, CASE WHEN toxic = 1 THEN 'muted' ELSE 'interested' END AS decision FROM labels WHERE toxic = 1 OR quality = 1)"
ENTRIES_SQL = """
n AS (SELECT p_partkey % 500 AS journal_id, p_brand AS catalog, p_size % 2 = 0 AS official, 1990 + p_size AS year, p_partkey AS load_ord,
  'Q' || CAST(p_size % 4 + 1 AS VARCHAR) AS quartile FROM part)"""


def papers(spark: SparkSession, sf: str, spread_out: bool = False) -> DataFrame:
    """spread_out: both sides of the join are dealt over all of the session's shuffle partitions."""
    d, o = table(spark, sf, "documents"), table(spark, sf, "orders")
    if spread_out:
        d, o = spread(d, "doc_id"), spread(o, "o_orderkey")
    return d.join(o, d.doc_id == o.o_orderkey).select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("language"), "source",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("discovery_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("journal_id"),
        F.floor("o_totalprice").alias("citation_count"),
    )


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("source"), (F.col("user_id") % 7).alias("topic"), (F.col("event_type") != "error").alias("ok"),
        F.col("event_type").alias("status"), F.floor("value").alias("found"), F.floor(F.col("value") / 10).alias("added"), "props",
    )


def judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").where("toxic = 1 or quality = 1")
    return rows.select(F.col("doc_id").alias("paper_id"), F.when(F.col("toxic") == 1, "muted").otherwise("interested").alias("decision"))


def journals(spark: SparkSession, sf: str) -> DataFrame:
    """ISSNs for two thirds of the customers; a variant is the name with its number only."""
    c = table(spark, sf, "customer")
    issn = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("c_nationkey") * 7 % 10000).cast("string"), 4, "0")))
    return c.select(F.col("c_custkey").alias("journal_id"), F.col("c_name").alias("name"), issn.alias("issn"), F.array(F.concat(F.lit("Journal "), F.col("c_custkey").cast("string"))).alias("name_variants"), F.col("c_mktsegment").alias("catalog"), (F.col("c_acctbal") > 0).alias("official"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select((F.col("p_partkey") % 500).alias("journal_id"), F.col("p_brand").alias("catalog"), (F.col("p_size") % 2 == 0).alias("official"), (F.col("p_size") + 1990).alias("year"), F.col("p_partkey").alias("load_ord"), F.concat(F.lit("Q"), (F.col("p_size") % 4 + 1).cast("string")).alias("quartile"))
