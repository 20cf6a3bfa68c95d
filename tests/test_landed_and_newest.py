"""XML files of bounded size, and texts of the newest papers alone."""

from lectern.plans import desk_queries, evidence_queries, record_queries


def test_landed_xml_files_are_bounded(spark, sf, monkeypatch):
    before = record_queries.a5_atom(spark, sf)
    monkeypatch.setattr(record_queries, "ENTRIES", 20)
    found = record_queries.a5_atom(spark, sf)
    assert len(found.inputFiles()) >= found.count() / 20 > 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, before.collect()))


def test_only_the_newest_texts_are_looked_at(spark, sf):
    every = evidence_queries._frontier(spark, sf)
    want = every.orderBy(every.discovery_date.desc(), "id").limit(30)
    assert sorted(map(tuple, evidence_queries._frontier(spark, sf, 30).collect())) == sorted(map(tuple, want.collect()))
    plan = desk_queries.i11_frontier_picks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("regexp_replace") :]
