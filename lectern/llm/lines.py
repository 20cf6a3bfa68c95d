"""Lines that stand in many documents, taken out of all of them.

Every line has a key: the line without white space at its ends, A-Z as a-z.  One scan hashes the keys (128 bits) and writes
them, document by document and in the order of lines; lines are then exploded from that table, never with their text:
documents and lines are counted for each hash with partial sums, and the places of lines over the threshold are gathered for
each document.  The texts are shuffled once, to meet the places, and put together again from the lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.language import let
from lectern.llm.repeats import keyed
from lectern.operators.skew import join_by_weight
from lectern.session import materialize

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """A-Z as a-z and no other letter; a text of ASCII alone takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return let(F.btrim(line, F.lit(WHITE)), fold)


def _hash(line: Column) -> Column:
    """The MD5 of a line's key as hexadecimal digits, since arrays of strings are compared by hash tables; of an empty key empty."""
    return let(key_of(line), lambda k: F.when(k == "", "").otherwise(F.md5(k)))


def drop_common_lines(documents: DataFrame, min_documents: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept, *keep) of every row: `kept` is the text without the lines whose key stands in at least
    `min_documents` documents.

    A null or empty text is one empty line; empty keys never count, so empty lines stay; if no line stays, kept is empty.
    Rows are documents of their own even if they repeat a doc_id or have none; a line that a document repeats counts once
    for it and goes everywhere.  Lines and texts may be of any length.  An empty table gives no rows; columns other than
    doc_id, text and `keep` are ignored, whatever their names.
    """
    rows = keyed(documents, keep)
    hashed = materialize(rows.select("row", F.transform(lines_of(F.col("text")), _hash).alias("keys")), "line-keys")
    in_order = let(F.array_sort(F.filter("keys", lambda k: k != "")), lambda s: F.transform(s, lambda k, i: F.struct(F.unhex(k).alias("key"), F.when((i == 0) | (F.get(s, i - 1) != k), 1).otherwise(0).alias("first"))))
    counts = hashed.select(F.explode(in_order).alias("line")).groupBy("line.key").agg(F.sum("line.first").alias("documents"), F.count(F.lit(1)).alias("lines"))
    common = materialize(counts.where(F.col("documents") >= min_documents).select("key", "lines"), "common-lines")
    placed = hashed.select("row", F.posexplode("keys").alias("place", "digits")).where("digits <> ''").select("row", "place", F.unhex("digits").alias("key"))
    dropped = join_by_weight(placed, common, "key", "lines").groupBy("row").agg(F.collect_list("place").alias("places"))
    whole = rows.join(dropped, "row", "left").withColumn("lines", lines_of(F.col("text")))
    stay = let(F.col("lines"), lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("places")), lambda i: F.get(own, i)), "\n"))
    return whole.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(stay).alias("kept"), *keep,
    )
