import json
import os
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import journals, library, merge, select
from lectern.sources import imports, interchange, readers
from lectern.streaming.upserts import keyed_table, rolling_health, stream_upserts

MERGE = {"title": "longest", "pages": "value", "oa": "any", "cites": "max", "sources": "union"}


def test_merge_is_a_left_fold(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 20), i, "x" * rng.randint(0, 5), rng.choice(["None", "1-2", "3", None]), rng.random() < 0.2, rng.choice([0, 3, 8]), [rng.choice("abc")]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, ord long, title string, pages string, oa boolean, cites long, sources array<string>")
    found = {r.k: r for r in merge.merge_records(df.repartition(7), "k", "ord", MERGE).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        assert found[k].title == max((r[2] for r in own), key=len)
        assert found[k].pages == next((r[3] for r in own if r[3] not in (None, "None")), None)
        assert found[k].oa == any(r[4] for r in own)
        assert found[k].cites == (max(r[5] for r in own) or None)
        assert found[k].sources == list(dict.fromkeys(x for r in own for x in r[6]))


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", ["x"], "d1"), (2, "b", ["y"], "d1")], "id int, doi string, tags array<string>, first string")
    batch = spark.createDataFrame([(2, None, ["z"], "d2"), (3, "c", [], "d2")], "id int, doi string, tags array<string>, first string")
    policy = {"doi": "fill", "tags": "union", "first": "keep"}
    once = merge.upsert(base, batch, "id", policy).drop("change")
    twice = merge.upsert(once, batch, "id", policy).drop("change")
    want = {(1, "a", ("x",), "d1"), (2, "b", ("y", "z"), "d1"), (3, "c", (), "d2")}
    assert {(r.id, r.doi, tuple(r.tags), r.first) for r in once.collect()} == {(r.id, r.doi, tuple(r.tags), r.first) for r in twice.collect()} == want


def test_pruned_greedy_is_greedy(spark):
    rng, categories = random.Random(2), ["a", "b", "c"]
    rows = [("d", i, rng.choice(["new", "catchup", "shown"]), rng.choice(["en", "zh"]), sorted(rng.sample(categories, rng.randint(0, 3))), rng.choice([0.1, 0.2, 0.3, 0.5])) for i in range(400)]
    columns = ["day", "id", "kind", "language", "category_ids", "score"]
    df = spark.createDataFrame(rows, "day string, id long, kind string, language string, category_ids array<string>, score double")
    for limit in (5, 20, 60):
        found = [r.id for r in select.diverse_pick(df, "day", categories, limit).orderBy("rank").collect()]
        assert found == list(select.greedy(pd.DataFrame(rows, columns=columns), categories, limit)["id"])


def test_official_entry_stays(spark):
    rows = [(1, "ssci", True, 2019, 1, "Q1"), (1, "ssci", False, 2024, 2, "Q4"), (1, "jcr", False, 2020, 3, "Q2"), (1, "jcr", False, 2021, 4, "Q3")]
    df = spark.createDataFrame(rows, "journal_id int, catalog string, official boolean, year int, load_ord int, quartile string")
    assert {(r.catalog, r.quartile) for r in journals.apply_entries(df).collect()} == {("ssci", "Q1"), ("jcr", "Q3")}


def test_undo_is_refused_after_a_later_action(spark):
    log = spark.createDataFrame([(1, "mute", "p1", 1), (2, "mute", "p1", 2), (3, "star", "p1", 3)], "action_id int, kind string, subject string, at int")
    assert {r.action_id for r in library.can_undo(log).collect()} == {2, 3}


def test_bibtex(spark, tmp_path):
    text = '@comment{skip}\n@string{x = "y"}\n@article{k1,\n  title = {A {N}ested Title},\n  author = "One, A and Two, B",\n  year = 2020,\n  month = mar,\n  note = {has\n@inside braces},\n  doi = {10.1234/ABC}\n}\n@inproceedings{k2, title = {Second} # { part}, year = {1999}}\n@book{, title={no key}}\n'
    (tmp_path / "b.bib").write_text(text)
    found = {r.key: r for r in readers.read_bibtex(spark, str(tmp_path / "b.bib")).collect()}
    assert set(found) == {"k1", "k2"}
    assert found["k1"].title == "A Nested Title" and found["k1"].authors == ["One, A", "Two, B"] and found["k1"].issued_date == "2020-03" and found["k1"].doi == "10.1234/abc"
    assert found["k2"].title == "Second part"


def test_bibtex_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a1", ["Ann"], "Some Title", "Journal", "2001", None)], "k string, a array<string>, t string, j string, y string, d string")
    df.select(interchange.bibtex(*(F.col(c) for c in "katjyd")).alias("value")).write.text(str(tmp_path / "out"))
    r = readers.read_bibtex(spark, str(tmp_path / "out")).first()
    assert (r.key, r.title, r.authors, r.year) == ("a1", "Some Title", ["Ann"], "2001")


def test_json_readers(spark, tmp_path):
    work = {"message": {"items": [{"DOI": "10.1234/X", "title": ["T"], "author": [{"given": "A", "family": "B"}], "ISSN": ["12345678"], "issued": {"date-parts": [[2020, 5]]}}, {"title": []}]}}
    (tmp_path / "w.json").write_text(json.dumps(work))
    r = readers.read_works(spark, str(tmp_path / "w.json")).collect()
    assert [(x.doi, x.title, x.authors, x.issn, x.issued_date) for x in r] == [("10.1234/x", "T", ["A B"], "1234-5678", "2020-05")]
    graph = {"results": [{"title": "G", "doi": "https://doi.org/10.1234/g", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "keywords": [{"display_name": "k1", "score": 0.1}, {"display_name": "k2", "score": 0.9}], "open_access": {"is_oa": True}}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    g = readers.read_graph(spark, str(tmp_path / "g.json")).first()
    assert (g.abstract, g.keywords, g.open_access) == ("a b a", ["k2", "k1"], True)
    (tmp_path / "e.json").write_text(json.dumps({"response": {"docs": [{"id": "E1", "title": "T", "publicationtype": ["Journal Articles"], "publicationdateyear": 2020, "url": "https://doi.org/10.1234/E", "peerreviewed": "T"}]}}))
    e = readers.read_eric(spark, str(tmp_path / "e.json")).first()
    assert (e.doc_type, e.doi, e.peer_reviewed) == ("journal-article", "10.1234/e", True)


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2101.00001v3</id><title>A\n title</title><summary>S</summary><published>2021-01-02T00:00:00Z</published><author><name>N</name></author></entry></feed>")
    a = readers.read_atom(spark, str(tmp_path / "a.xml")).first()
    assert (a.id, a.title, a.published_date, a.authors) == ("2101.00001", "A title", "2021-01-02", ["N"])


def test_imports(spark):
    text = "A1 Ann\nA1 Bob\nT1 A long\n   title\nJF Journal\nYR 2020\n\nT1 Second\n"
    df = spark.createDataFrame([(1, text)], "i int, t string")
    found = {(r.record, r.tag): r["values"] for r in imports.tagged_records(df, "t", "i").collect()}
    assert found[(0, "A1")] == ["Ann", "Bob"] and found[(0, "T1")] == ["A long title"] and found[(1, "T1")] == ["Second"]
    line = spark.createDataFrame([("[1] 张三，李四. 语言研究[J]. 中国语文, 2020, 12(3): 1-9",), ("no",)], "l string")
    c = [r.c for r in line.select(imports.parse_citation(F.col("l")).alias("c")).collect()]
    assert c[0].authors == ["张三", "李四"] and c[0].journal_name == "中国语文" and c[0].pages == "1-9" and c[1] is None


def test_catalog_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿Journal Name,ISSN,JCR Year\n"A ""quoted"" name",1234-5678,2020\n,,\n')
    found = imports.read_catalog(spark, str(tmp_path / "c.csv"), {"name": ("journal_name", "期刊名称"), "issn": ("issn",), "year": ("jcryear",), "note": ("note",)}).collect()
    assert [(r.name, r.issn, r.year, r.note) for r in found] == [('A "quoted" name', "1234-5678", "2020", None)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "id long, ord long, title string, sources array<string>"
    rows = [(1, 1, "a", ["s1"]), (2, 2, "b", ["s1"]), (1, 3, "aaa", ["s2"]), (3, 4, "c", ["s2"])]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "table")
    fold, policy = {"title": "longest", "sources": "union"}, {"title": "overwrite", "sources": "union"}
    stream_upserts(stream, out, "id", "ord", fold, policy, str(tmp_path / "cp")).awaitTermination()
    found = keyed_table(spark, out, None)
    assert {(r.id, r.title, tuple(sorted(r.sources))) for r in found.collect()} == {(1, "aaa", ("s1", "s2")), (2, "b", ("s1",)), (3, "c", ("s2",))}
    assert found.count() == 3


def test_rolling_health(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' as at, 's' as source, true as ok union all select timestamp'2024-01-05 10:00:00', 's', false")
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    query = rolling_health(spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))).writeStream.format("memory").queryName("health").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.requests, r.n_failed) for r in spark.table("health").collect()] == [(1, 0)]


def test_queries_of_whole_tables(spark, sf):
    from lectern import registry
    from lectern.plans import views

    ids = sorted(r.id for r in views.papers(spark, sf).select("id").collect())
    for name in ("h1c_normalize_title_all", "h2e_resolve_language_all"):
        assert sorted(r.id for r in registry.QUERIES[name](spark, sf).select("id").collect()) == ids
    longest = lambda name: registry.QUERIES[name](spark, sf).selectExpr("doc_id", "length(sentence) n").groupBy("doc_id").sum("n").agg({"sum(n)": "max"}).first()[0]
    assert 2000 < longest("h6c_evidence") <= 46_000


def test_undo_joins_one_row_a_group(spark):
    from lectern.operators import library

    log = spark.createDataFrame([(1, "k", "a", 1), (2, "k", "a", 2), (2, "k", "b", 1), (3, "k", "b", 1), (4, "m", "a", 0), (5, "k", None, 0)], "action_id int, kind string, subject string, at int")
    found = library.can_undo(log)
    assert sorted(r.action_id for r in found.collect()) == [2, 3, 4, 5]
    assert "max(at" in found._jdf.queryExecution().optimizedPlan().toString()


def test_null_keys_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "id int, k string")
    other = spark.createDataFrame([("a", 7)], "k string, v int")
    assert sorted((r.id, r.v) for r in journals.keyed_join(rows, other, "k").fillna(-1).collect()) == [(1, 7), (2, -1), (3, -1), (4, -1)]


def test_title_rules_of_research():
    from lectern.operators.desk import NON_RESEARCH

    pattern = re.compile("|".join(NON_RESEARCH))
    skipped = ["书评", "简讯", "勘误", "征文启事", "新书目", "年度总目录", "本刊稿约", "投稿须知"]
    assert all(pattern.search(t) for t in skipped)
    assert not any(pattern.search(t) for t in ["汉语书评的语体研究", "Contents of heavy metals in soil", "Indexing of large corpora", "词汇研究"])


def test_days_are_replaced(spark, tmp_path):
    schema = "run_date string, id int"
    for rows in ([("d1", 1), ("d1", 2), ("d2", 3)], [("d1", 9)]):
        select.write_days(spark.createDataFrame(rows, schema), str(tmp_path / "days"))
    assert sorted((r.run_date, r.id) for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [("d1", 9), ("d2", 3)]


def test_log_is_appended(spark, tmp_path):
    from lectern.operators import audit

    e = spark.sql("select timestamp'2024-01-01' as at, 's' as source, 't' as topic, false as ok, 500 as http_status, 0 as found, 0 as added, repeat('x', 900) as message, 5 as ms")
    for _ in range(2):
        audit.append_log(e, str(tmp_path / "log"))
    assert [len(r.message) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [500, 500]


def test_daily_items_of_a_run_made_again(spark):
    c = spark.createDataFrame([("2024-01-02", 1, "2024-01-02", "en", 0.9), ("2024-01-02", 2, "2024-01-01", "zh", 0.8), ("2024-01-02", 3, "2024-01-02", "fr", 1.0), ("2024-01-02", 4, "2024-01-02", "en", 0.7), ("2024-01-02", 5, "2024-01-02", "en", 0.6)], "run_date string, id int, discovery_date string, language string, score double")
    shown = spark.createDataFrame([(1, "2024-01-02"), (4, "2024-01-01")], "id int, run_date string")
    days = select.days_due(c.select("run_date").distinct(), spark.createDataFrame([("2024-01-02", "empty")], "run_date string, status string"))
    items = select.daily_items(c, days, shown, spark.createDataFrame([(5,)], "id int"), 8)
    assert [(r.id, r.kind, r["rank"]) for r in items.orderBy("rank").collect()] == [(1, "new", 1), (2, "catchup", 2)]
    assert select.days_due(days, spark.createDataFrame([("2024-01-02", "ok")], "run_date string, status string")).count() == 0


def test_intermediate_tables_are_released(spark):
    from lectern import session

    session.release(spark)
    path = session.materialize(spark.range(3), "some").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and session.release(spark) == 1 and not os.path.exists(path)


def test_journals_match_without_keys(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "1234-5678", None), (3, None, "A & B")], "row_id int, issn string, journal_name string")
    j = spark.createDataFrame([(7, "A &amp; B", None, ["x"]), (8, "other", "12345678", None)], "journal_id int, name string, issn string, name_variants array<string>")
    assert sorted((r.row_id, r.journal_id, r.matched_by) for r in journals.match_journals(rows, j).fillna(-1).collect()) == [(1, -1, "none"), (2, 8, "issn"), (3, 7, "name")]
