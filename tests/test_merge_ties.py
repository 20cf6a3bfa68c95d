"""Merging where lines of an order are tied, where columns are null and where quantities are no whole numbers, beside the SQL."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern import registry
from lectern.session import placed
from tests.oracle import connect, expected, rows

SCHEMA = pa.schema([
    ("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()),
    ("l_extendedprice", pa.float64()), ("l_tax", pa.float64()), ("l_returnflag", pa.string()), ("l_linestatus", pa.string()),
])


@pytest.mark.parametrize("quantities, nulls", [((3.0,), 0.0), ((0.5, 1.5, 2.5, 2.6), 0.0), ((1.0, 2.0), 0.4)])
def test_merge_equals_its_sql(spark, tmp_path, quantities, nulls):
    rng = random.Random(5)
    some = lambda values: None if rng.random() < nulls else rng.choice(values)
    # few lines an order, in one row group: there DuckDB takes tied lines as they lie
    lines = [(rng.randrange(150), some((5, 6)), some(range(30)), some((1, 2)), some(quantities), some((0.5, 7.5)), some((0.01, 0.08)), some("NAR"), some("FO")) for _ in range(600)]
    pq.write_table(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines), SCHEMA.types, strict=True)], schema=SCHEMA), tmp_path / "lineitem.parquet")
    assert rows(registry.QUERIES["d14_merge"](spark, str(tmp_path)).repartition(3)) == expected(connect(str(tmp_path)), registry.ORACLES["d14_merge"])


def test_places_go_by_file_and_row(spark, tmp_path):
    for name, ids in (("b", [4, 5, 6]), ("a", [3, 1, 2])):
        pq.write_table(pa.table({"id": ids}), tmp_path / f"{name}.parquet")
    one, all_ = placed(spark.read.parquet(str(tmp_path / "a.parquet"))), placed(spark.read.parquet(str(tmp_path)))
    assert [r.id for r in one.orderBy("place").collect()] == [3, 1, 2]
    assert [r.id for r in all_.orderBy("place").collect()] == [3, 1, 2, 4, 5, 6]
