"""A memo writes hashes and values, never the rows; equal rows are computed once."""

from pyspark.sql import functions as F

from lectern.operators import memo


def test_rows_are_not_written(spark, tmp_path, monkeypatch):
    written, keep = [], memo.materialize
    monkeypatch.setattr(memo, "materialize", lambda df, name: written.append(df.columns) or keep(df, name))
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (2, "bb"), (None, "c")], "id long, text string")
    run = lambda df: memo.memoise(df, "id", "x", lambda d: d.withColumn("n", F.length("text")), str(tmp_path / "m"), ("n",), parts=3)
    first, second = run(rows), run(rows)
    assert (first.computed, second.computed, second.reused) == (3, 0, 3)
    assert sorted((r.text, r.n) for r in second.rows.collect()) == [("a", 1), ("bb", 2), ("bb", 2), ("c", 1)]
    assert written and not any("text" in columns for columns in written)
