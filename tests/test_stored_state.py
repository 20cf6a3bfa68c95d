"""Days that appear at once, loads that skip what they know, calls that are made once, pages that are read alone."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import calls, days, desk, pages
from lectern.sources import sync

# --- days -----------------------------------------------------------------------------------------------------------


def test_a_failed_run_leaves_the_day(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "days")
    items = lambda *rows: spark.createDataFrame([(d, i, "new") for d, i in rows], "run_date string, id long, kind string")
    both = items(("2024-01-01", 0), ("2024-01-02", 0)).select("run_date")
    told = lambda: sorted((r.run_date, r.id) for r in days.items(spark, path).collect())
    days.commit(items(("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3)), both, path, "t1")
    assert told() == [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3)]
    with monkeypatch.context() as m:
        m.setattr(days, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            days.commit(items(("2024-01-01", 9)), both, path, "t2")
    assert told() == [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3)]
    days.commit(items(("2024-01-01", 7)), items(("2024-01-01", 0)).select("run_date"), path, "t3")
    assert told() == [("2024-01-01", 7), ("2024-01-02", 3)]
    days.commit(items(), items(("2024-01-02", 0)).select("run_date"), path, "t4")
    assert told() == [("2024-01-01", 7)] and {r.run_date: (r.status, r["items"]) for r in days.runs(spark, path).collect()} == {"2024-01-01": ("ok", 1), "2024-01-02": ("empty", 0)}
    assert days.sweep(spark, path) == 2 and told() == [("2024-01-01", 7)]


# --- sync -----------------------------------------------------------------------------------------------------------


def test_sync_skips_what_it_knows(spark, tmp_path):
    folder, state, calls_made = tmp_path / "in", str(tmp_path / "state"), []
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.txt").write_text(f"text {i}")
    names = lambda paths: sorted(os.path.basename(p) for p in paths)
    run = lambda apply=lambda paths, batch: calls_made.append((names(paths), batch)): sync.sync(spark, str(folder), state, apply, "*.txt")
    assert run() == sync.Synced(4, 4, 0, 0, 1) and calls_made.pop() == (["0.txt", "1.txt", "2.txt", "3.txt"], 1)
    assert run() == sync.Synced(4, 0, 0, 0, 1) and not calls_made
    os.utime(folder / "1.txt", (time.time() + 50, time.time() + 50))
    assert run() == sync.Synced(4, 0, 1, 0, 2) and not calls_made and run() == sync.Synced(4, 0, 0, 0, 2)
    (folder / "2.txt").write_text("other")
    (folder / "3.txt").unlink()
    with pytest.raises(ZeroDivisionError):
        run(lambda paths, batch: 1 / 0)
    assert run() == sync.Synced(3, 1, 0, 1, 3) and calls_made.pop() == (["2.txt"], 3)
    (folder / "3.txt").write_text("text 3")
    assert run() == sync.Synced(4, 1, 0, 0, 4) and {os.path.basename(r.path) for r in sync.state(spark, state).collect()} == {f"{i}.txt" for i in range(4)}


def test_a_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = sync.listing(spark, str(tmp_path), "*.txt")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


# --- calls ----------------------------------------------------------------------------------------------------------


def model_in(folder):
    def model(texts):
        for t in texts:
            with open(f"{folder}/{t}", "a") as f:
                f.write("x")
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    return model


def test_calls_are_limited_and_made_once(spark, tmp_path):
    made, path = tmp_path / "made", str(tmp_path / "calls")
    made.mkdir()
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(["a", "b", "a", None, " ", "bad", "c", "d", "e"])], "id long, text string, priority long")
    run = lambda limit, at, **more: {r.id: (r.status, r.reply) for r in calls.work_through(rows, path, model_in(made), limit, at, at_once=1, **more).collect()}
    counts = lambda: {n: os.path.getsize(made / n) for n in os.listdir(made)}
    first = run(3, "1")
    assert first == {0: ("ok", "A"), 2: ("ok", "A"), 1: ("ok", "B"), 5: ("failed", None), 3: (None, None), 4: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}
    claimed = calls.claim(rows, path, 2, "2")  # and the run breaks off here
    lost = run(9, "3")
    assert lost[8] == ("ok", "E") and lost[6] == lost[7] == ("lost", None) and lost[5] == ("failed", None) and counts() == {"a": 1, "b": 1, "bad": 1, "e": 1}
    assert run(9, "4") == lost and counts()["e"] == 1
    again = run(9, "5", again=("lost", "failed"))
    assert again[6] == ("ok", "C") and again[7] == ("ok", "D") and again[5] == ("failed", None) and counts() == {"a": 1, "b": 1, "bad": 2, "c": 1, "d": 1, "e": 1}
    assert claimed and calls.replies(spark, path).count() == 6


def test_a_task_that_starts_again_calls_nobody(monkeypatch):
    class Second:
        @staticmethod
        def get():
            return type("C", (), {"attemptNumber": staticmethod(lambda: 1)})

    monkeypatch.setattr(calls, "TaskContext", Second)
    found = pd.concat(calls._call(lambda texts: 1 / 0, 2)(iter([pd.DataFrame({"digest": list("abc"), "text": list("xyz")})])))
    assert list(found["status"]) == ["lost"] * 3 and list(found["error"]) == [None] * 3


# --- pages ----------------------------------------------------------------------------------------------------------


def test_a_page_is_the_offset_page_and_reads_one_folder(spark, tmp_path):
    rows = spark.range(1003).select("id", (F.col("id") * 37 % 11).cast("double").alias("score"), F.when(F.col("id") % 5 > 0, F.col("id") * 7 % 13).alias("date"))
    order, path = [F.col("score").desc(), F.col("date").desc_nulls_last(), F.col("id")], str(tmp_path / "pages")
    assert pages.store_pages(rows, order, path, 10, pages_of_folder=7, parts=9) == 101
    for n in (1, 2, 7, 8, 50, 101, 102):
        found = pages.read_page(spark, path, n, 7)
        assert [r.id for r in found.collect()] == [r.id for r in desk.page(rows, order, n, 10).collect()]
        scan = found._jdf.queryExecution().executedPlan().toString()
        assert f"folder#" in scan and "PartitionFilters: [isnotnull(folder" in scan
    files = {f for f in spark.read.parquet(path).where("folder = 3").inputFiles() if "folder=3" in f}
    assert len(files) == 1
    assert pages.store_pages(rows.where("false"), order, str(tmp_path / "none"), 10) == 0
