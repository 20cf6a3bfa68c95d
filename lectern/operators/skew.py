"""Joins with a table of one row a key, when one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1_000


def join_by_weight(rows: DataFrame, keys: DataFrame, key: str, weight: str) -> DataFrame:
    """The inner join of rows with `keys`, a written table of one row a key; `weight` says how many of the rows have it.

    Keys of more than one in SHARE of all weighed rows, of which there can be no more than SHARE, are broadcast, so that
    their rows stay where they are; the others are shuffled, none of them more than that share.  A null key joins nothing.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * SHARE > total
    heavy = F.broadcast(keys.where(hot))
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(keys.where(~hot), key))
