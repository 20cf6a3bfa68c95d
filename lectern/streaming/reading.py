"""Reading states of the works of several streams, as picks and states come in."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lectern.functions.identifiers import normalize_doi
from lectern.streaming.states import ROCKS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in states

PARTS = 256  # groups of keys whose waiting rows are kept together
_OUT = "subject string, linked string, place int, state string, at timestamp"


def _doi(c: Column) -> Column:
    return F.concat(F.lit("doi:"), normalize_doi(c))


def _own(c: Column) -> Column:
    return F.concat(F.lit("own:"), c)


class NewestInWindow(StatefulProcessor):
    """Rows of two kinds, picks and states, of a part of all keys: each pick meets the newest state of its window, no other."""

    def __init__(self, window: int):
        self.window = window  # microseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows binary")

    def _rows(self, found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"subject": found["subject"], "linked": found["linked"], "place": found["place"].astype("int32"), "state": found["state"], "at": pd.to_datetime(found["seen"], unit="us")})

    def _ended(self, held: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What still waits, and picks whose window ended without a state."""
        over = held["micros"] + self.window < watermark
        return held[~over], held[over & held["pick"] & held["seen"].isna()]

    def _keep(self, held: pd.DataFrame, watermark: int) -> None:
        self.waiting.update((pickle.dumps(held),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(held):
            self.handle.registerTimer(max(watermark // 1000, (int(held["micros"].min()) + self.window) // 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([x.assign(seen=pd.array([pd.NA] * len(x), "Int64")) for x in rows], ignore_index=True)
        held = pd.concat([pickle.loads(self.waiting.get()[0]), new], ignore_index=True) if self.waiting.exists() else new
        picks, states = held[held["pick"]], held[~held["pick"]].sort_values(["micros", "state"], na_position="first")
        ends = picks.assign(end=picks["micros"] + self.window).sort_values("end")
        near = pd.merge_asof(ends, states[["key", "micros", "state"]], left_on="end", right_on="micros", by="key", suffixes=("", "_new"))
        near = near.set_axis(ends.index)
        hit = near["micros_new"].notna() & (near["micros_new"] >= near["micros"] - self.window)
        better = near[hit & ~((near["micros_new"] == near["seen"]).fillna(False) & (near["state_new"] == near["state"]))].index
        held.loc[better, "seen"] = near.loc[better, "micros_new"].astype("Int64")
        held.loc[better, "state"] = near.loc[better, "state_new"]
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        told = held.loc[better]
        held, alone = self._ended(held, watermark)
        self._keep(held, watermark)
        yield self._rows(pd.concat([told, alone]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        held, alone = self._ended(pickle.loads(self.waiting.get()[0]), watermark)
        self._keep(held, watermark)
        yield self._rows(alone)

    def close(self) -> None:
        pass


def reading_rows(picks: DataFrame, states: DataFrame, window: str, late: str) -> DataFrame:
    """(subject, linked, place, state, at) of two streams: picks (subject, doi, linked, picked_at) and states (subject, doi, state, at).

    A pick waits under each key that may know its state, in order of `place`: the work that it is linked to, its DOI, its
    own name; a state under its subject and its DOI.  A place has a row for the newest state from `window` before to `window`
    after the pick, again when a newer one comes, and one without a state if none came by then: however many states and
    picks share a key, a micro-batch gives at most one row a place.  Both streams may be `late`; what is older than watermark
    and window is forgotten on either side, so that the state is bounded by the rows of one window.
    """
    spark = picks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    micros = spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {window}"))).first()[0]
    keys = F.array(*(F.struct(F.lit(i).alias("place"), key.alias("key")) for i, key in enumerate((_own(F.col("linked")), _doi(F.col("doi")), _own(F.col("subject"))))))
    none = F.lit(None).cast("string")
    left = picks.withWatermark("picked_at", late).select("subject", "linked", F.col("picked_at").alias("at"), F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("k"))
    left = left.select("at", "subject", "linked", "k.place", "k.key", none.alias("state"), F.lit(True).alias("pick"))
    right = states.withWatermark("at", late).select("at", none.alias("subject"), none.alias("linked"), F.lit(-1).alias("place"), F.explode(F.array_compact(F.array(_own(F.col("subject")), _doi(F.col("doi"))))).alias("key"), "state", F.lit(False).alias("pick"))
    both = left.unionByName(right).select("*", F.unix_micros("at").alias("micros"), F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part"))
    return both.groupBy("part").transformWithStateInPandas(NewestInWindow(micros), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def keep_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the join gives to a table, exactly once, until all there is has been read."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def current_states(rows: DataFrame) -> DataFrame:
    """(subject, linked, state) from the rows so far: of a pick's first place that has a state the newest one."""
    newest = lambda place: F.max_by(F.when(F.col("place") == place, F.col("state")), F.when((F.col("place") == place) & F.col("state").isNotNull(), F.struct("at", "state")))
    return rows.groupBy("subject").agg(F.max("linked").alias("linked"), F.coalesce(*map(newest, range(3))).alias("state"))
