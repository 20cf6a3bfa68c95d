"""One DOI that all picks and states share: a row a place, not one for each pair."""

from datetime import datetime, timedelta

from lectern.streaming import reading


def test_a_shared_key_gives_one_row_a_place(spark, tmp_path):
    start = datetime(2024, 1, 1)
    picks = spark.createDataFrame([(f"p{i}", "10.1000/x", None, start + timedelta(seconds=i)) for i in range(60)], "subject string, doi string, linked string, picked_at timestamp")
    told = spark.createDataFrame([(f"q{i}", "10.1000/x", f"s{i:03}", start + timedelta(seconds=i)) for i in range(80)], "subject string, doi string, state string, at timestamp")
    streams = []
    for name, rows in (("picks", picks), ("states", told)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}"))
    reading.keep_rows(reading.reading_rows(*streams, window="30 seconds", late="1 day"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    found = {r.subject: r.state for r in spark.read.schema("subject string, linked string, place int, state string, at timestamp").parquet(f"{tmp_path}/out").collect()}
    assert found == {f"p{i}": f"s{min(i + 30, 79):03}" for i in range(60)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
