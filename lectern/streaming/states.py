"""What is known of each source, kept as state of a stream of log rows, row by row and in whatever order they come."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lectern.streaming.upserts import stream_upserts

# Spark looks at a processor in a process beside the driver, which has none of the files that are sent to executors: its code goes along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds and the id of the last row, the last that went well and the last that failed; then sums.
_STATE = "last_at long, last_id long, last_status string, ok_at long, ok_id long, failed_at long, failed_id long, added long, first_seen long, checks long"
_OUT = "source string, ord long, last_check long, last_ok long, last_status string, added long, first_seen long, recovered boolean, silent boolean"
STATES = "last_check timestamp, last_ok timestamp, last_status string, added long, first_seen timestamp, recovered boolean, silent boolean"


def _later(old: tuple, at: int, ident: int) -> bool:
    return old[0] is None or (at, ident) > tuple(old)


class SourceState(StatefulProcessor):
    """Folds rows into maxima and sums, so that any cut of the log and any order give the same.

    A timer waits `silent_after` behind the newest row of a source: if it goes off, the source is reported as silent;
    `forget_after` (0: never) is the life of a state without rows, after which a source starts anew.
    """

    def __init__(self, silent_after: int, forget_after: int):
        self.silent_after, self.forget_after = silent_after, forget_after

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", _STATE)

    def _row(self, key: tuple, s: tuple, silent: bool) -> pd.DataFrame:
        last_at, last_id, status, ok_at, ok_id, failed_at, failed_id, added, first, checks = s
        recovered = ok_at is not None and failed_at is not None and (ok_at, ok_id) > (failed_at, failed_id)
        return pd.DataFrame({
            "source": [key[0]], "ord": [2 * checks + silent], "last_check": [last_at], "last_ok": pd.array([ok_at], "Int64"), "last_status": [status], "added": [added], "first_seen": [first],
            "recovered": [recovered], "silent": [silent],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [None, None, None, None, None, None, None, 0, None, 0]
        s = list(self.state.get()) if self.state.exists() else list(new)
        for part in rows:
            for at, ident, ok, status, added in zip(part["micros"].tolist(), part["id"].tolist(), part["ok"].tolist(), part["status"].tolist(), part["added"].tolist(), strict=True):
                if self.forget_after and s[0] is not None and at - s[0] >= 1_000 * self.forget_after:
                    s = [*new[:9], s[9]]  # its timer goes off after the rows of a batch
                if _later((s[0], s[1]), at, ident):
                    s[0], s[1], s[2] = at, ident, status
                place = 3 if ok else 5
                if _later((s[place], s[place + 1]), at, ident):
                    s[place], s[place + 1] = at, ident
                s[7] += 0 if added is None or added != added else int(added)
                s[8] = at if s[8] is None else min(s[8], at)
                s[9] += 1
        self.state.update(tuple(s))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for wait in (self.silent_after, self.forget_after):
            if wait:
                self.handle.registerTimer(s[0] // 1000 + wait)
        yield self._row(key, tuple(s), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        s = tuple(self.state.get())
        if self.forget_after and expiredTimerInfo.getExpiryTimeInMs() >= s[0] // 1000 + self.forget_after:
            self.state.clear()
        else:
            yield self._row(key, s, True)

    def close(self) -> None:
        pass


def source_states(log: DataFrame, silent_after: int, forget_after: int = 0, late: str = "0 seconds") -> DataFrame:
    """(source, ord, last_check, last_ok, last_status, added, first_seen, recovered, silent) of a stream of (source, at, id, ok,
    status, added): a row for each source and micro-batch that heard of it, and one when it fell silent (milliseconds of
    event time); the row of the highest `ord` counts.  Rows without source or time are ignored; a null `ok` is a failure.

    Rows up to `late` behind the newest one count, in whatever order they come; later ones are dropped, as timers have passed.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = log.where("source is not null and at is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    rows = rows.select("source", "at", F.unix_micros("at").alias("micros"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"), "status", F.col("added").cast("long").alias("added"))
    found = rows.groupBy("source").transformWithStateInPandas(SourceState(silent_after, forget_after), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("last_check", "last_ok", "first_seen")})


def keep_states(log: DataFrame, path: str, checkpoint: str, silent_after: int, late: str = "1 day", parts: int = 8) -> StreamingQuery:
    """The newest state of each source in a keyed table, batch by batch, until all rows there are have been read."""
    columns = ["last_check", "last_ok", "last_status", "added", "first_seen", "recovered", "silent"]
    last = {c: "last" for c in columns}
    return stream_upserts(source_states(log, silent_after, late=late), path, "source", "ord", last, {c: "overwrite" for c in columns}, checkpoint, parts, mode="update")


def replay(spark: SparkSession, log: DataFrame, path: str, cuts: int) -> DataFrame:
    """A log as a stream that comes in `cuts` micro-batches: landed in so many files, dealt by a hash of the id."""
    log.repartition(cuts, F.xxhash64("id")).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
