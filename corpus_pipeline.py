"""A training corpus from raw documents: each stage is one operator of lectern.llm, run over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, near_dup, packing, repeats, suffix_dedup
from lectern.session import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages labelled in them; texts that no language's model explains go.

    A null text, or one without a letter, goes.  A null lang teaches nothing, and its row is judged like any other; rows
    are judged one by one, repeated ones alike; an empty table, or one without any label, gives no rows.
    """
    models = langid.train(docs, F.lit(True))
    return langid.predict(docs, models, keep=tuple(COLUMNS[1:])).where("not rejected").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, similarity 0.8).

    Null and empty texts are like nothing and stay; rows that repeat a doc_id are documents of their own, of which equal
    ones leave one, a row without doc_id the last choice of its group; an empty table gives no rows.
    """
    rows = repeats.keyed(docs, tuple(COLUMNS[2:]), nulls_last=True)
    kept = near_dup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere; documents of which nothing is left go.

    A cut is moved to the borders of characters, so that a character of which a part was cut goes as a whole.  Uncut rows
    stay as they are, null and empty texts too; rows that repeat each other lose what they share, a null doc_id counts as
    any; an empty table gives no rows.
    """
    found = suffix_dedup.remove_repeats(docs, keep=tuple(COLUMNS[2:]), whole_characters=True)
    whole = F.size("spans") == 0
    left = found.where(whole | (F.trim(F.col("kept").cast("string")) != ""))
    text = F.when(~(whole & F.col("empty")), F.col("kept").cast("string"))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows.

    Null and empty texts have no words and stay; rows are judged one by one, repeated ones and those without doc_id too;
    an empty benchmark keeps all, an empty table gives no rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), tuple(COLUMNS[2:])).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences.

    A null text is an empty one, just its end mark; repeated rows are packed each, a null doc_id as any; an empty table
    gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", drop_repeated_strings),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
