"""States of sources on a stream: the same in any cut of the log, and timers for sources that fall silent."""

import random
from datetime import datetime, timedelta

import pytest

from lectern.operators import audit
from lectern.streaming import states
from lectern.streaming.upserts import keyed_table

SCHEMA = "id long, at timestamp, source string, ok boolean, status string, added long"
DAY = 86_400_000


def log_of(spark, rng, n=120):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=rng.randint(0, 9_000)), rng.choice("abcd"), rng.random() < 0.6, rng.choice(["ok", "bad"]), rng.choice([None, 1, 5])) for i in range(n)]
    rows += [(n + i, rows[0][1], "tie", i % 2 == 0, f"s{i}", 1) for i in range(4)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("cuts", [1, 4])
def test_any_cut_ends_with_the_same(spark, tmp_path, cuts):
    rows, log = log_of(spark, random.Random(cuts))
    log = log.unionByName(spark.createDataFrame([(900, None, "a", True, "x", 1), (901, rows[0][1], None, True, "x", 1)], SCHEMA))
    stream = states.replay(spark, log, str(tmp_path / "log"), cuts)
    states.keep_states(stream, str(tmp_path / "table"), str(tmp_path / "cp"), 10 * DAY, late="30 days").awaitTermination()
    found = keyed_table(spark, str(tmp_path / "table"), f"source string, {states.STATES}").collect()
    want = {r.source: r for r in audit.source_state(log.where("at is not null and source is not null")).collect()}
    assert {r.source for r in found} == set(want) == set("abcd") | {"tie"}
    for r in found:
        w = want[r.source]
        assert (r.last_check, r.last_ok, r.last_status, r.added or None, r.first_seen) == (w.last_check, w.last_ok, w.last_status, w.added, w.first_seen)
        own = [x for x in rows if x[2] == r.source]
        ok, bad = (max(((x[1], x[0]) for x in own if x[3] is good), default=None) for good in (True, False))
        assert r.recovered == (ok is not None and bad is not None and ok > bad) and not r.silent


def test_a_source_falls_silent_and_is_forgotten(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    batches = [[(1, day(1), "a", True, "ok", 1), (2, day(1), "b", False, "bad", 2)], [(3, day(4), "b", True, "ok", 3)], [(4, day(5), "b", True, "ok", 1)], [(5, day(12), "b", True, "ok", 1)], [(6, day(13), "a", True, "ok", 7)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = []
    found = states.source_states(stream, silent_after=2 * DAY, forget_after=6 * DAY)
    found.writeStream.outputMode("update").foreachBatch(lambda df, i: got.extend((r.source, r.silent, r.added) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert ("a", True, 1) in got and got.index(("a", True, 1)) > got.index(("a", False, 1))
    assert got[-1] == ("a", False, 7) or ("a", False, 7) in got  # forgotten, so it starts anew
    assert ("b", False, 2) in got and ("b", False, 5) in got and ("b", False, 6) in got


def test_reading_states_on_two_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from lectern.operators import library
    from lectern.streaming import reading

    rng, start = random.Random(7), datetime(2024, 1, 1)
    at = lambda i: start + timedelta(hours=i)
    picks = [(f"p{i}", rng.choice([None, f"10.1000/{i % 9}"]), rng.choice([None, f"p{rng.randint(0, 40)}"]), at(i)) for i in range(40)]
    told = [(f"p{rng.randint(0, 60)}", rng.choice([None, f"10.1000/{rng.randint(0, 12)}"]), f"s{i}", at(rng.randint(0, 40))) for i in range(60)]
    schemas = "subject string, doi string, linked string, picked_at timestamp", "subject string, doi string, state string, at timestamp"
    ahead = [("ahead", None, None, datetime(2090, 1, 1))], [("ahead", None, "x", datetime(2090, 1, 1))]
    for window, whole in (("3000 days", True), ("5 hours", False)):
        own = str(tmp_path / window.replace(" ", "-"))
        streams = []
        for name, rows, more, schema in zip(("picks", "states"), (picks, told), ahead, schemas, strict=True):
            for part in (rows[::2], rows[1::2], more):
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{own}/{name}")
            streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{own}/{name}"))
        for _ in range(2):
            reading.keep_rows(reading.reading_rows(*streams, window=window, late="60 days" if whole else "40 hours"), f"{own}/out", f"{own}/cp").awaitTermination()
        rows = spark.read.schema("subject string, linked string, place int, state string, at timestamp").parquet(f"{own}/out")
        found = {r.subject: r.state for r in reading.current_states(rows.where("subject <> 'ahead'")).collect()}
        if whole:
            want = library.reading_states(spark.createDataFrame(picks, schemas[0]), spark.createDataFrame(told, schemas[1]))
            assert found == {r.subject: r.state for r in want.collect()} and None in found.values()
        else:
            near = lambda p, s: abs((p[3] - s[3]).total_seconds()) <= 5 * 3600
            for p in picks:
                keys = [p[2] and ("o", p[2]), p[1] and ("d", p[1]), ("o", p[0])]
                own_rows = [[(s[3], s[2]) for s in told if k and near(p, s) and k in (("o", s[0]), ("d", s[1]))] for k in keys]
                assert found[p[0]] == next((max(x)[1] for x in own_rows if x), None)
            assert rows.groupBy().agg(F.count("state")).first()[0] > 0
