from lectern.operators import journals, revalidation

PAPERS = "id long, issn string, journal_name string, language string, status string"
JOURNALS = "journal_id long, name string, issn string, name_variants array<string>, blacklisted boolean"
ENTRIES = "journal_id long, catalog string, official boolean, ssci_indexed boolean, quartiles array<string>, zone int"


def test_standings_are_compared_in_as_many_tasks_as_the_session_shuffles_to(spark):
    rows = spark.range(8).selectExpr("id", "'pending' AS status", "CAST(NULL AS STRING) AS missing")
    seen = journals.changed_since(rows.selectExpr("id AS paper_id", "status"), rows.select("id", "status"))
    notes = journals.refresh_notes(rows, rows.selectExpr("id", "'x' AS note"))[0]
    for df in (seen, notes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan.split("SortMergeJoin")[0]
        assert df.count() == 8


def test_repeated_papers_are_judged_each(spark):
    papers = spark.createDataFrame([(1, None, "Mind", "en", "pending")] * 2, PAPERS)
    own = spark.createDataFrame([(7, "mind", None, [], False), (3, "other", None, ["Mind"], False)], JOURNALS)
    found = revalidation.judge(papers, own, spark.createDataFrame([], ENTRIES)).collect()
    assert [(r.id, r.journal_id, r.journal_name) for r in found] == [(1, 7, "Mind")] * 2
