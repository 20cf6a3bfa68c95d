"""Queries of lists, runs of a day, a reader's library and journal verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import identifiers
from lectern.operators import audit, calls, days, desk, history, journals, library, merge, reasons, revalidation, select
from lectern.plans import views
from lectern.plans.evidence_queries import _FRONTIER_SQL, _frontier
from lectern.plans.queries import ORACLES, query
from lectern.plans.views import JUDGED_SQL, LOG_SQL, PAPERS_SQL, TODAY
from lectern.session import materialize, shared_dir, table
from lectern.sources import sync
from lectern.streaming import reading

# --- the discovery list ---------------------------------------------------------------------------------------------

_DESK_SQL = f"""{PAPERS_SQL}, {JUDGED_SQL}, m AS (SELECT DISTINCT paper_id FROM j WHERE decision = 'muted'),
r AS (SELECT p.id, title, abstract, discovery_date, language, 'Journal ' || journal_id AS journal_name, [source, priority] AS keywords, CASE WHEN id % 11 = 0 THEN 'excluded' WHEN status = 'F' THEN 'eligible' WHEN status = 'O' THEN 'reference' ELSE 'pending' END AS status,
  CASE WHEN status = 'F' AND id % 2 = 0 THEN 'official' ELSE 'other' END AS basis, id % 3 = 0 AS open_access, list_filter([CASE WHEN id % 2 = 0 THEN 'c1' END, CASE WHEN id % 5 < 3 THEN 'c2' END], lambda x: x IS NOT NULL) AS category_ids,
  list_filter([CASE WHEN id % 3 = 0 THEN 't1' END, CASE WHEN id % 4 = 0 THEN 't2' END], lambda x: x IS NOT NULL) AS topics, list_filter([CASE WHEN id % 7 = 0 THEN 't2' END], lambda x: x IS NOT NULL) AS cross_topics,
  CASE WHEN id % 6 = 0 THEN discovery_date END AS browsed_at, id % 9 = 0 AS shown, m.paper_id IS NOT NULL AS muted FROM p LEFT JOIN m ON m.paper_id = p.id),
rel AS (SELECT * FROM r WHERE NOT muted AND (len(topics) > 0 OR len(cross_topics) > 0))"""


def _desk(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    some = lambda *pairs: F.array_compact(F.array(*(F.when(c, v) for c, v in pairs)))
    status = F.when(i % 11 == 0, "excluded").when(F.col("status") == "F", "eligible").when(F.col("status") == "O", "reference").otherwise("pending")
    return views.papers(spark, sf).select(
        "id", "title", "abstract", "discovery_date", "language", F.concat(F.lit("Journal "), F.col("journal_id").cast("string")).alias("journal_name"), F.array("source", "priority").alias("keywords"), status.alias("status"),
        F.when((F.col("status") == "F") & (i % 2 == 0), "official").otherwise("other").alias("basis"), (i % 3 == 0).alias("open_access"), some((i % 2 == 0, "c1"), (i % 5 < 3, "c2")).alias("category_ids"),
        some((i % 3 == 0, "t1"), (i % 4 == 0, "t2")).alias("topics"), some((i % 7 == 0, "t2")).alias("cross_topics"), F.when(i % 6 == 0, F.col("discovery_date")).alias("browsed_at"), F.col("discovery_date").alias("created_at"), (i % 9 == 0).alias("shown"),
    )


def _muted(spark: SparkSession, sf: str) -> DataFrame:
    return views.judged(spark, sf).where("decision = 'muted'").select(F.col("paper_id").alias("id"))


@query(f"""WITH {_DESK_SQL} SELECT id, CASE WHEN discovery_date = '{TODAY}' THEN 'new' WHEN shown THEN 'shown' ELSE 'catchup' END AS kind FROM rel
WHERE status <> 'eligible' AND contains(lower(concat_ws(' ', title, abstract, journal_name, keywords[1], keywords[2])), 'that') AND list_contains(category_ids, 'c2') AND browsed_at IS NULL AND (list_contains(topics, 't2') OR list_contains(cross_topics, 't2')) AND language IN ('zh', 'en')""")
def b6_discovery_chain(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = desk.discovery_list(_desk(spark, sf), _muted(spark, sf), TODAY, journal_filter="unverified", words="that", category="c2", browse="unseen", topic="t2")
    return found.select("id", "kind")


@query(f"""WITH {_DESK_SQL} SELECT count(*) FILTER (WHERE language = 'zh') AS zh, count(*) FILTER (WHERE language = 'en') AS en, count(*) FILTER (WHERE language = 'id') AS id, count(*) FILTER (WHERE language = 'other') AS other, count(*) FILTER (WHERE language IS NULL) AS unknown, count(*) AS all_languages, count(*) FILTER (WHERE coalesce(language, 'unknown') NOT IN ('zh', 'en')) AS outside_scope FROM rel""")
def d7_language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return desk.discovery_list(_desk(spark, sf), _muted(spark, sf), TODAY)[1]


@query(f"""WITH {_DESK_SQL}, c AS (SELECT unnest(category_ids) AS category, discovery_date FROM rel) SELECT category, count(*) AS total, count(*) FILTER (WHERE discovery_date = '{TODAY}') AS n_new FROM c GROUP BY 1""")
def d9_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return desk.category_counts(desk.discovery_list(_desk(spark, sf), _muted(spark, sf), TODAY, scope="all")[0])


@query(f"WITH {_DESK_SQL} SELECT id, status = 'eligible' AND basis = 'official' AS official, status <> 'eligible' AS unverified, status = 'reference' AS reference, status = 'pending' AS pending, open_access FROM r")
def b5_eligibility_filters(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name: desk.eligibility_filter(name, F.col("status"), F.col("basis"), F.col("open_access")).alias(name)
    return _desk(spark, sf).select("id", *map(one, ("official", "unverified", "reference", "pending", "open_access")))


@query(f"WITH {_DESK_SQL} SELECT id, list_contains(topics, 't2') AS tagged FROM r")
def b3_array_membership(spark: SparkSession, sf: str) -> DataFrame:
    return _desk(spark, sf).select("id", desk.has_tag(F.col("topics"), "t2").alias("tagged"))


@query(f"WITH {_DESK_SQL} SELECT id FROM p WHERE id IN (SELECT id FROM r WHERE list_contains(category_ids, 'c1'))")
def c11_tag_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return desk.with_tag(views.papers(spark, sf).select("id"), "id", _desk(spark, sf).select("id", F.col("category_ids").alias("tags")), "c1")


@query(f"""WITH {_DESK_SQL}, l AS (SELECT id, language, CASE WHEN id % 2 = 0 THEN discovery_date END AS online, id % 2 = 0 AS starred, CASE id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'reading' ELSE 'unread' END AS read_state, topics, category_ids AS tags, title, abstract, journal_name, discovery_date FROM r)
SELECT id FROM l WHERE starred AND read_state = 'reading' AND language = 'en' AND contains(lower(journal_name), 'journal 1') AND list_contains(tags, 'c2') AND coalesce(online, discovery_date) BETWEEN '1992-01-01' AND '1999-12-31' AND (contains(lower(title), 'th') OR contains(lower(abstract), 'th'))""")
def b2_library_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    i, none = F.col("id"), F.lit(None).cast("string")
    rows = _desk(spark, sf).withColumns({"starred": i % 2 == 0, "read_state": F.when(i % 3 == 0, "read").when(i % 3 == 1, "reading").otherwise("unread"), "tags": F.col("category_ids"), "published_online": F.when(i % 2 == 0, F.col("discovery_date")), "issued_date": none, "authors": none, "note": none})
    return rows.where(desk.library_filter(starred=True, read_state="reading", language="en", journal="Journal 1", tag="c2", since="1992-01-01", until="1999-12-31", words="TH")).select("id")


@query(f"""WITH {PAPERS_SQL} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN discovery_date END, CASE WHEN id % 2 = 0 THEN '2001-07-01' END, discovery_date) >= strftime(DATE '{TODAY}' - 45, '%Y-%m-%d') AS brief,
  coalesce(CASE WHEN id % 2 = 0 THEN '2001-07-01' END, CASE WHEN id % 3 = 0 THEN discovery_date END, discovery_date) >= strftime(DATE '{TODAY}' - 60, '%Y-%m-%d') AND status <> 'P' AS discovery FROM p""")
def b10_windows(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    online, found, issued = F.when(i % 3 == 0, F.col("discovery_date")), F.when(i % 2 == 0, "2001-07-01"), F.col("discovery_date")
    status = F.when(F.col("status") == "P", "excluded").otherwise("pending")
    return views.papers(spark, sf).select("id", desk.brief_window(online, found, issued, TODAY, 30).alias("brief"), desk.discovery_window(online, found, issued, status, TODAY, 60).alias("discovery"))


@query(f"""WITH {PAPERS_SQL} SELECT id, (contains(lower(abstract), 'thon') OR contains(lower(abstract), 'xyz')) AND (id % 2 = 0 OR contains(lower(abstract), 'der ')) AS excluded FROM p""")
def b8_excluded_by_all(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda *words: F.struct(F.array(*map(F.lit, words)).alias("excluded"))
    found_by = F.when(F.col("id") % 2 == 0, F.array(one("Thon", "xyz"))).otherwise(F.array(one("Thon", "xyz"), one("der ")))
    return views.papers(spark, sf).select("id", desk.excluded_by_all(F.col("abstract"), found_by).alias("excluded"))


@query("""WITH c AS (SELECT c_custkey AS journal_id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_nationkey * 7 % 10000 AS VARCHAR), 4, '0') END AS issn, 'Journal ' || c_custkey AS v, c_acctbal > 0 AS verified FROM customer)
SELECT journal_id, name FROM c WHERE contains(lower(name), '11') OR contains(issn, '11') OR contains(lower(v), '11') ORDER BY verified DESC, name, journal_id LIMIT 300""")
def b4_journal_search(spark: SparkSession, sf: str) -> DataFrame:
    return desk.journal_search(views.journals(spark, sf).withColumnRenamed("official", "verified"), "11").select("journal_id", "name")


@query(f"""WITH {LOG_SQL} SELECT id, source FROM g WHERE NOT ok AND "at" >= TIMESTAMP '2024-01-01 00:00:00' ORDER BY "at" DESC, id DESC LIMIT 20""")
def b15_last_failures(spark: SparkSession, sf: str) -> DataFrame:
    return audit.tail(views.log(spark, sf), 20, since="2024-01-01 00:00:00", failures=True).select("id", "source")


@query(f"""WITH {LOG_SQL} SELECT id, "at" FROM g ORDER BY "at" DESC, id DESC LIMIT 500""")
def f8_log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return audit.tail(views.log(spark, sf), 500).select("id", "at")


@query(f"""WITH {PAPERS_SQL}, d AS (SELECT id, trim(title) AS title, 'J' || journal_id AS journal_name, language, CASE WHEN id % 4 = 0 THEN 'n/a' ELSE CAST(id AS VARCHAR) END AS volume, CASE WHEN id % 5 = 0 THEN '3-None' ELSE '3-9' END AS pages,
  CASE WHEN id % 2 = 0 THEN discovery_date END AS o, CASE WHEN id % 3 = 0 THEN substr(discovery_date, 1, 7) END AS pr, substr(discovery_date, 1, 4) AS i, abstract FROM p),
b AS (SELECT *, CASE WHEN o IS NOT NULL AND o NOT LIKE '%-01-01' THEN 'online' WHEN pr IS NOT NULL THEN 'print' WHEN o IS NOT NULL THEN 'online' ELSE 'issued' END AS date_kind FROM d), v AS (SELECT *, CASE date_kind WHEN 'online' THEN o WHEN 'print' THEN pr ELSE i END AS date FROM b)
SELECT id, title, journal_name, language, CASE WHEN volume <> 'n/a' THEN volume END AS volume, NULL AS issue, CASE WHEN pages = '3-None' THEN '3' ELSE pages END AS pages, date,
  CASE WHEN length(date) = 4 OR date LIKE '%-01-01' THEN 'year' WHEN length(date) = 7 THEN 'month' ELSE 'day' END AS precision, date_kind, length(abstract) > 0 AS has_abstract FROM v""")
def b16_cards(spark: SparkSession, sf: str) -> DataFrame:
    i, day = F.col("id"), F.col("discovery_date")
    rows = views.papers(spark, sf).withColumns({
        "journal_name": F.concat(F.lit("J"), F.col("journal_id").cast("string")), "volume": F.when(i % 4 == 0, "n/a").otherwise(i.cast("string")), "issue": F.lit("none"), "pages": F.when(i % 5 == 0, "3-None").otherwise("3-9"),
        "published_online": F.when(i % 2 == 0, day), "published_print": F.when(i % 3 == 0, F.substring(day, 1, 7)), "issued_date": F.substring(day, 1, 4),
    })
    return desk.cards(rows)


# --- runs -----------------------------------------------------------------------------------------------------------

_RUNS_SQL = """ru AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS run_date FROM orders WHERE o_orderkey % 40 = 0), ri AS (SELECT run_date, row_number() OVER (ORDER BY run_date) AS run_id FROM ru)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs are the days of every fortieth order, numbered by day."""
    days = table(spark, sf, "orders").where("o_orderkey % 40 = 0").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date")).distinct()
    return days.withColumn("run_id", F.datediff(F.col("run_date").cast("date"), F.lit("1970-01-01").cast("date")))


@query(f"""WITH {PAPERS_SQL}, i AS (SELECT l_orderkey AS paper_id, l_linenumber AS run_id, l_partkey AS rank FROM lineitem) SELECT run_id, rank, paper_id, language, source FROM i JOIN p ON p.id = paper_id""")
def c1_run_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("run_id"), F.col("l_partkey").alias("rank"))
    return library.run_items(items, views.papers(spark, sf).select("id", "language", "source"))


@query("""SELECT l_linenumber AS run_id, l_partkey AS item_id, l_suppkey AS rank, p_name AS name, '2001-01-0' || l_linenumber AS run_date FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 3""")
def c8_pick_items(spark: SparkSession, sf: str) -> DataFrame:
    picks = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("run_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("rank"))
    runs = picks.select("run_id").distinct().where("run_id <= 3").withColumn("run_date", F.concat(F.lit("2001-01-0"), F.col("run_id").cast("string")))
    return library.pick_items(picks, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), runs).select("run_id", "item_id", "rank", "name", "run_date")


@query(f"""WITH {PAPERS_SQL}, {JUDGED_SQL}, d AS (SELECT DISTINCT discovery_date AS run_date FROM p WHERE id % 2 = 0), du AS (SELECT run_date FROM d WHERE CAST(substr(run_date, 9, 2) AS INTEGER) % 5 <> 0),
c AS (SELECT strftime(CAST(discovery_date AS DATE) + CAST(id % 3 AS INTEGER), '%Y-%m-%d') AS run_date, id, discovery_date, language, citation_count % 1000 AS score FROM p), sh AS (SELECT id, min(strftime(CAST(discovery_date AS DATE) + CAST(id % 2 AS INTEGER), '%Y-%m-%d')) AS f FROM p WHERE id % 5 = 0 GROUP BY 1),
o AS (SELECT c.*, f FROM c JOIN du USING (run_date) LEFT JOIN sh USING (id) WHERE c.id NOT IN (SELECT paper_id FROM j WHERE decision = 'muted')),
k AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY score DESC, id) AS rank FROM o WHERE (f IS NULL OR f >= run_date) AND language IN ('zh', 'en'))
SELECT run_date, id, CASE WHEN discovery_date = run_date THEN 'new' ELSE 'catchup' END AS kind, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def i10_daily_items(spark: SparkSession, sf: str) -> DataFrame:
    items, _ = _daily(spark, sf)
    return items


def _daily(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = views.papers(spark, sf)
    later = lambda n: F.date_format(F.date_add(F.col("discovery_date").cast("date"), (F.col("id") % n).cast("int")), "yyyy-MM-dd")
    days = p.where("id % 2 = 0").select(F.col("discovery_date").alias("run_date")).distinct()
    done = days.select("run_date", F.when(F.substring("run_date", 9, 2).cast("int") % 5 == 0, "ok").otherwise("empty").alias("status"))
    due = select.days_due(days, done)
    candidates = p.select(later(3).alias("run_date"), "id", "discovery_date", "language", (F.col("citation_count") % 1000).alias("score"))
    shown = p.where("id % 5 = 0").select("id", later(2).alias("run_date"))
    return select.daily_items(candidates, due, shown, _muted(spark, sf), 3), due


@query(f"""WITH {PAPERS_SQL}, {JUDGED_SQL}, d AS (SELECT DISTINCT discovery_date AS run_date FROM p WHERE id % 2 = 0), du AS (SELECT run_date FROM d WHERE CAST(substr(run_date, 9, 2) AS INTEGER) % 5 <> 0),
c AS (SELECT strftime(CAST(discovery_date AS DATE) + CAST(id % 3 AS INTEGER), '%Y-%m-%d') AS run_date, id, discovery_date, language FROM p), sh AS (SELECT id, min(strftime(CAST(discovery_date AS DATE) + CAST(id % 2 AS INTEGER), '%Y-%m-%d')) AS f FROM p WHERE id % 5 = 0 GROUP BY 1),
o AS (SELECT c.run_date, count(*) AS n, count(*) FILTER (WHERE discovery_date = c.run_date) AS w FROM c LEFT JOIN sh USING (id) WHERE c.id NOT IN (SELECT paper_id FROM j WHERE decision = 'muted') AND (f IS NULL OR f >= c.run_date) AND language IN ('zh', 'en') GROUP BY 1)
SELECT du.run_date, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, least(coalesce(n, 0), 3) AS items FROM du LEFT JOIN o ON o.run_date = du.run_date""")
def i10_run_rows(spark: SparkSession, sf: str) -> DataFrame:
    items, due = _daily(spark, sf)
    return select.run_rows(due, items).select("run_date", "status", "items")


@query(f"""WITH {_FRONTIER_SQL}, nw AS (SELECT id, discovery_date AS first_seen, n_directions, score, 's' || id % 3 AS source FROM v ORDER BY discovery_date DESC, id LIMIT 2000), fr AS (SELECT * FROM nw WHERE n_directions > 0 AND id % 4 <> 1),
of_source AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k FROM fr), pk AS (SELECT *, row_number() OVER (ORDER BY k > 2, score DESC, id) AS place FROM of_source)
SELECT id, source, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, first_seen = '{TODAY}' AS is_new FROM pk WHERE place <= 8""")
def i11_frontier_picks(spark: SparkSession, sf: str) -> DataFrame:
    found = _frontier(spark, sf, 2_000)
    items = found.select("id", F.col("discovery_date").alias("first_seen"), "n_directions", "score", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    return select.frontier_picks(items, items.where("id % 4 = 1").select("id"), TODAY, 8)


@query(f"WITH {_RUNS_SQL} SELECT max(run_date) AS run_date FROM ri")
def e11_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return audit.latest_run(_runs(spark, sf)).select("run_date")


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) SELECT run_date, run_id FROM r WHERE k = 1""")
def e2_latest_per_day(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date"), F.col("o_orderkey").alias("run_id"))
    return merge.latest_by(runs, ["run_date"], [F.col("run_id").desc()])


@query(f"""WITH {PAPERS_SQL}, a AS (SELECT count(*) FILTER (WHERE status = 'F' AND language = 'zh') AS zh_eligible, count(*) FILTER (WHERE status = 'F' AND language = 'en') AS en_eligible, count(*) FILTER (WHERE status = 'F' AND coalesce(language, '') NOT IN ('zh', 'en')) AS other_eligible, count(*) FILTER (WHERE status = 'P' AND language = 'zh') AS zh_pending FROM p),
b AS (SELECT count(*) FILTER (WHERE language = 'zh') AS zh_selected, count(*) FILTER (WHERE language = 'en') AS en_selected, count(*) FILTER (WHERE coalesce(language, '') NOT IN ('zh', 'en')) AS other_selected, greatest(50 - count(*), 0) AS shortfall FROM p WHERE id % 17 = 0)
SELECT *, zh_selected > 0 AND en_selected > 0 AS balanced FROM a, b""")
def d10_language_coverage(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "language", F.when(F.col("status") == "F", "eligible").when(F.col("status") == "P", "pending").otherwise("reference").alias("status"))
    return audit.language_coverage(p, p.where("id % 17 = 0"), 50).withColumn("shortfall", F.col("shortfall").cast("long"))


# --- a reader's library ---------------------------------------------------------------------------------------------

_LIBRARY_SQL = "li AS (SELECT doc_id AS paper_id, quality = 1 AS starred, CASE doc_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'reading' ELSE 'unread' END AS read_state FROM labels)"


def _library(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("doc_id") % 3 == 0, "read").when(F.col("doc_id") % 3 == 1, "reading").otherwise("unread")
    return table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") == 1).alias("starred"), state.alias("read_state"))


@query(f"WITH {PAPERS_SQL}, {_LIBRARY_SQL} SELECT paper_id, starred, read_state, title FROM li JOIN p ON p.id = paper_id")
def c9_library_papers(spark: SparkSession, sf: str) -> DataFrame:
    return library.library_papers(_library(spark, sf), views.papers(spark, sf).select("id", "title"))


@query(f"WITH {PAPERS_SQL}, {JUDGED_SQL} SELECT paper_id, decision, paper_id * 7 % 1000 AS \"at\", language FROM j JOIN p ON p.id = paper_id WHERE decision = 'interested'")
def c10_judged_papers(spark: SparkSession, sf: str) -> DataFrame:
    judged = views.judged(spark, sf).withColumn("at", F.col("paper_id") * 7 % 1000)
    return library.judged_papers(judged, views.papers(spark, sf).select("id", "language"), "interested")


@query(f"""WITH {PAPERS_SQL}, {_LIBRARY_SQL}, {JUDGED_SQL}, e AS (SELECT user_id AS id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1), t AS (SELECT conv_id AS id, count(*) FILTER (WHERE role = 'assistant') AS k FROM conversations GROUP BY 1), s AS (SELECT paper_id AS id, bool_or(starred) AS starred FROM li GROUP BY 1), q AS (SELECT paper_id AS id, max(decision) AS decision FROM j GROUP BY 1)
SELECT p.id, coalesce(starred, false) AS starred, coalesce(n, 0) AS interpretations, last AS browsed_at, decision, coalesce(k, 0) AS translations FROM p LEFT JOIN s ON s.id = p.id LEFT JOIN e ON e.id = p.id LEFT JOIN q ON q.id = p.id LEFT JOIN t ON t.id = p.id""")
def c13_card_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("paper_id"), F.col("ts").alias("browsed_at"))
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("paper_id"), F.when(F.col("role") == "assistant", "ok").otherwise("failed").alias("status"))
    judged = views.judged(spark, sf).withColumn("at", F.col("paper_id"))
    return library.enrich_cards(views.papers(spark, sf).select("id"), _library(spark, sf), e, e, judged, t)


@query("""SELECT conv_id AS interp_id, array_to_string(list('S' || turn ORDER BY turn, role), ',') AS sids FROM conversations GROUP BY 1""")
def c16_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("interp_id"), F.col("turn").alias("ord"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("sid"))
    return library.snapshots(m).withColumn("sids", F.array_join("sids", ","))


@query("""WITH m AS (SELECT conv_id AS interp_id, 'S' || turn AS sid, coalesce(max(text), '') AS text FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1, 2), w AS (SELECT DISTINCT conv_id AS interp_id, 'S' || (turn + 1) AS sid FROM conversations)
SELECT w.interp_id, w.sid, text, CASE WHEN text IS NOT NULL THEN 'found' WHEN w.interp_id % 3 <> 0 THEN 'unknown' ELSE 'no-snapshot' END AS state FROM w LEFT JOIN m ON m.interp_id = w.interp_id AND m.sid = w.sid""")
def c19_evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("interp_id", F.col("conv_id"))
    sid = lambda n: F.concat(F.lit("S"), (F.col("turn") + n).cast("string"))
    kept = c.where("conv_id % 3 <> 0").groupBy("interp_id", sid(0).alias("sid")).agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    return library.evidence_lookup(c.select("interp_id", sid(1).alias("sid")).distinct(), kept)


@query(f"""WITH {PAPERS_SQL}, {_LIBRARY_SQL}, {JUDGED_SQL} SELECT p.id, p.title, c_name AS journal_name, c_acctbal > 0 AS official, coalesce(starred, false) AS starred, read_state, length(text) AS fulltext_chars, decision
FROM p LEFT JOIN customer ON c_custkey = p.journal_id LEFT JOIN li ON li.paper_id = p.id LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 4 = 0) ON doc_id = p.id LEFT JOIN j ON j.paper_id = p.id""")
def c20_details(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    full = table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("paper_id"), "text")
    return library.details(p, p.select("id", "title", "journal_id"), views.journals(spark, sf), _library(spark, sf), full, views.judged(spark, sf)).select("id", "title", "journal_name", "official", "starred", "read_state", F.col("fulltext_chars").cast("long").alias("fulltext_chars"), "decision")


@query(f"""WITH {PAPERS_SQL}, {_LIBRARY_SQL}, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE starred) AS starred, count(*) FILTER (WHERE read_state = 'read') AS n_read, count(*) FILTER (WHERE read_state = 'reading') AS n_reading, count(*) FILTER (WHERE starred AND read_state = 'unread') AS unread FROM li),
b AS (SELECT count(*) AS papers, count(*) FILTER (WHERE status = 'F' AND id % 2 = 0) AS eligible, count(*) FILTER (WHERE status = 'O') AS reference, count(*) FILTER (WHERE status = 'P') AS pending FROM p) SELECT * FROM a, b""")
def d2_overview(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select(F.when(F.col("status") == "F", "eligible").when(F.col("status") == "O", "reference").otherwise("pending").alias("status"), F.when(F.col("id") % 2 == 0, "official").otherwise("x").alias("basis"))
    return library.overview(_library(spark, sf), p)


@query("""SELECT p_brand AS journal_name, count(*) AS n FROM part GROUP BY 1""")
def d16_imports_per_journal(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counts_by(table(spark, sf, "part").select(F.col("p_brand").alias("journal_name")), "journal_name")


@query("""SELECT CASE p_size % 3 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'conference-paper' ELSE 'other' END AS doc_type, count(*) AS n FROM part GROUP BY 1""")
def d17_items_by_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "article").when(F.col("p_size") % 3 == 1, "InProceedings").otherwise("misc")
    return audit.counts_by(table(spark, sf, "part").select(identifiers.bib_doc_type(kind).alias("doc_type")), "doc_type")


@query(f"""WITH {PAPERS_SQL}, k AS (SELECT id, list_distinct([lower(source), lower(language), 'x']) AS kw FROM p), l AS (SELECT id, list_filter(kw, lambda w: w IN ('en', 'x' || id % 3)) AS leaked FROM k) SELECT id, array_to_string(leaked, ',') AS leaked FROM l WHERE len(leaked) > 0""")
def d23_vocabulary_leaks(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", F.array(F.upper("source"), F.upper("language"), F.lit("x")).alias("keywords"), F.array(F.lit("en"), F.concat(F.lit("x"), (F.col("id") % 3).cast("string"))).alias("topics"))
    return library.leaks(p).withColumn("leaked", F.array_join("leaked", ","))


@query(f"""WITH {PAPERS_SQL} SELECT id, CASE WHEN id % 4 IN (0, 1) THEN '作者关键词（题录导入）' WHEN id % 4 = 2 THEN 'OpenAlex 提取的关键词' WHEN id % 3 = 0 THEN '作者关键词' ELSE '关键词' END AS label, id % 4 IN (0, 1) AS author_supplied, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS n FROM p""")
def h6j_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    source = F.when(i % 4 == 0, "imported").when(i % 4 == 1, "imported:cnki").when(i % 4 == 2, "openalex")
    keywords = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    rows = views.papers(spark, sf).select("id", keywords.alias("keywords"), source.alias("keywords_source"), F.array("language").alias("db_topics"), F.array("priority").alias("topics"))
    return library.vocabulary(rows).select("id", "keywords.label", "keywords.author_supplied", F.size("keywords.items").alias("n"))


@query(f"""WITH {PAPERS_SQL} SELECT id, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'was ' || id ELSE status END AS status FROM p""")
def i13_undo(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "status")
    log = p.where("id % 4 = 0").select((F.col("id") % 3).cast("int").alias("action_id"), F.lit("status").alias("kind"), F.col("id").alias("subject"), F.concat(F.lit("was "), F.col("id").cast("string")).alias("before"))
    return library.undo(p, log, 0, "status")


_HISTORY_SQL = """e AS (SELECT CAST(user_id AS VARCHAR) AS owner, event_id AS seq, row_number() OVER w AS n, event_type = 'view' AS u, CASE event_id % 3 WHEN 0 THEN lag(event_id, 1) OVER w WHEN 1 THEN lag(event_id, 2) OVER w ELSE lag(event_id, 3) OVER w END AS target,
  CASE WHEN event_id % 2 = 0 THEN 'star' ELSE 'tags' END AS kind, ['s' || CAST(floor(value) AS BIGINT) % 4, 't' || event_id % 3] AS subjects, 'v' || event_id AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT DISTINCT owner, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a BIGINT, kind VARCHAR, subjects VARCHAR[], value VARCHAR)[]) AS live FROM e UNION ALL
  SELECT f.owner, e.n, CASE WHEN NOT e.u OR e.target IS NULL THEN CASE WHEN e.u THEN live ELSE list_append(live, struct_pack(a := seq, kind := kind, subjects := subjects, value := value)) END
    WHEN len(list_filter(live, lambda y: y.a > target AND len(list_filter(live, lambda x: x.a = target AND x.kind = y.kind AND list_has_any(x.subjects, y.subjects))) > 0)) > 0 THEN live ELSE list_filter(live, lambda x: x.a <> target) END
  FROM f JOIN e ON e.owner = f.owner AND e.n = f.n + 1)"""


@query(f"""WITH RECURSIVE {_HISTORY_SQL}, z AS (SELECT owner, unnest(arg_max(live, n)) AS x FROM f GROUP BY 1) SELECT owner, kind, subject, arg_max(value, a) AS value, max(a) AS seq FROM (SELECT owner, x.kind AS kind, x.a AS a, x.value AS value, unnest(x.subjects) AS subject FROM z) AS a GROUP BY 1, 2, 3""")
def i13_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Actions on two subjects each, and undos of one of the owner's last three steps: what is in force in the end."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    undo = F.when(i % 3 == 0, F.lag("event_id", 1).over(w)).when(i % 3 == 1, F.lag("event_id", 2).over(w)).otherwise(F.lag("event_id", 3).over(w))
    subjects = F.array(F.concat(F.lit("s"), (F.floor("value") % 4).cast("string")), F.concat(F.lit("t"), (i % 3).cast("string")))
    rows = e.select(F.col("user_id").cast("string").alias("owner"), i.alias("seq"), (F.col("event_type") == "view").alias("u"), undo.alias("before"), F.when(i % 2 == 0, "star").otherwise("tags").alias("kind"), subjects.alias("subjects"), F.concat(F.lit("v"), i.cast("string")).alias("value"))
    log = rows.select("owner", "seq", F.when(~F.col("u"), F.col("seq")).alias("action_id"), F.when(F.col("u"), F.coalesce("before", F.lit(-1))).alias("undo_of"), "kind", F.when(~F.col("u"), F.col("subjects")).alias("subjects"), "value")
    return history.as_of(log, materialize(history.decide(log), "decided"))


# --- journals and verdicts ------------------------------------------------------------------------------------------

_CATALOGS = ("cssci", "cssci_ext", "cn_core", "ref_cssci", "ref_cssci_ext", "ssci_list", "ssci_jcr", "ref_ssci", "ref_jcr", "ref_esci")
_CATALOG_ENTRIES_SQL = f"""ce AS (SELECT p_partkey % 90 AS journal_id, [{", ".join(repr(c) for c in _CATALOGS)}][p_partkey % 10 + 1] AS catalog, p_size % 2 = 0 AND p_partkey % 10 NOT IN (3, 4, 7, 8, 9) AS official, 1990 + p_size AS year, p_partkey AS load_ord, p_size % 5 <> 0 AS ssci_indexed,
  CASE WHEN p_partkey % 10 IN (6, 7, 8) THEN ['Q' || (p_size % 4 + 1)] ELSE [] END AS quartiles, CASE WHEN p_size % 6 = 0 THEN CAST(p_size % 4 + 1 AS INTEGER) END AS zone FROM part)"""


def _catalog_entries(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    quartiles = F.when((k % 10).isin(6, 7, 8), F.array(F.concat(F.lit("Q"), (size % 4 + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select((k % 90).alias("journal_id"), F.element_at(F.array(*map(F.lit, _CATALOGS)), (k % 10 + 1).cast("int")).alias("catalog"), ((size % 2 == 0) & ~(k % 10).isin(3, 4, 7, 8, 9)).alias("official"), (size + 1990).alias("year"), k.alias("load_ord"), (size % 5 != 0).alias("ssci_indexed"), quartiles.alias("quartiles"), F.when(size % 6 == 0, (size % 4 + 1).cast("int")).alias("zone"))


_EVIDENCE_SQL = f"""{_CATALOG_ENTRIES_SQL}, ev AS (SELECT journal_id, bool_or(official AND catalog IN ('cssci', 'cn_core')) AS zh_official, bool_or(NOT official AND catalog IN ('cssci', 'ref_cssci')) AS zh_reference, bool_or(official AND catalog IN ('ssci_list', 'ssci_jcr') AND ssci_indexed) AS ssci,
  bool_or(NOT official AND catalog IN ('ssci_list', 'ssci_jcr', 'ref_jcr', 'ref_ssci')) AS ssci_reference, bool_or(catalog = 'ref_esci') AND NOT bool_or(catalog IN ('ssci_list', 'ssci_jcr', 'ref_ssci', 'ref_jcr')) AS esci_only, bool_or(official AND catalog = 'ssci_jcr' AND len(list_intersect(quartiles, ['Q1', 'Q2', 'Q3'])) > 0) AS ranked,
  bool_or(NOT official AND len(list_intersect(quartiles, ['Q1', 'Q2', 'Q3'])) > 0) AS ranked_reference, bool_or(coalesce(zone BETWEEN 1 AND 3, false)) AS zoned, bool_or(official) AS verified FROM ce GROUP BY 1)"""
_VERDICT_SQL = """CASE WHEN journal_id IS NULL THEN 'pending' WHEN blacklisted THEN 'excluded' WHEN (CASE WHEN language = 'zh' THEN coalesce(zh_official, false) ELSE coalesce(ssci AND (ranked OR zoned), false) END) THEN 'eligible'
  WHEN (CASE WHEN language = 'zh' THEN coalesce(zh_reference, false) ELSE coalesce(NOT esci_only AND ((ranked_reference AND (ssci_reference OR ssci)) OR (zoned AND ssci_reference)), false) END) THEN 'reference' ELSE 'pending' END"""
_REVALIDATED_SQL = f"""{PAPERS_SQL}, {_EVIDENCE_SQL}, jo AS (SELECT c_custkey AS k, lower(c_name) AS name, c_custkey % 13 = 0 AS blacklisted FROM customer), q AS (SELECT id, CASE WHEN id % 5 <> 0 THEN 'customer#' || lpad(CAST(journal_id AS VARCHAR), 9, '0') END AS name, CASE WHEN id % 2 = 0 THEN 'zh' ELSE language END AS language, CASE status WHEN 'F' THEN 'eligible' WHEN 'O' THEN 'reference' ELSE 'pending' END AS old_status FROM p),
rv AS (SELECT q.id, jo.k AS journal_id, q.language, old_status, blacklisted, ev.* EXCLUDE (journal_id) FROM q LEFT JOIN jo ON jo.name = q.name LEFT JOIN ev ON ev.journal_id = jo.k), ve AS (SELECT id, journal_id, language, old_status, {_VERDICT_SQL} AS status FROM rv)"""


def _papers_to_judge(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    return views.papers(spark, sf, spread_out=True).select("id", F.lit(None).cast("string").alias("issn"), F.when(i % 5 != 0, F.concat(F.lit("Customer#"), F.lpad(F.col("journal_id").cast("string"), 9, "0"))).alias("journal_name"), F.when(i % 2 == 0, "zh").otherwise(F.col("language")).alias("language"), F.when(F.col("status") == "F", "eligible").when(F.col("status") == "O", "reference").otherwise("pending").alias("status"))


def _revalidated(spark: SparkSession, sf: str) -> DataFrame:
    p = _papers_to_judge(spark, sf)
    j = table(spark, sf, "customer").select(F.col("c_custkey").alias("journal_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("issn"), F.array().cast("array<string>").alias("name_variants"), (F.col("c_custkey") % 13 == 0).alias("blacklisted"))
    return journals.revalidate(p, j, _catalog_entries(spark, sf))


@query(f"WITH {_REVALIDATED_SQL} SELECT id, journal_id, language, status, CASE status WHEN 'eligible' THEN 'official' ELSE status END AS basis, status <> old_status AS changed FROM ve")
def h5a_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _revalidated(spark, sf).select("id", "journal_id", "language", "status", "basis", "changed")


@query(f"WITH {_REVALIDATED_SQL} SELECT count(*) AS papers, count(journal_id) AS linked, count(*) FILTER (WHERE status = 'eligible') AS n_eligible, count(*) FILTER (WHERE status = 'reference') AS n_reference, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'excluded') AS n_excluded, count(*) FILTER (WHERE status <> old_status) AS changed FROM ve")
def i9_revalidation(spark: SparkSession, sf: str) -> DataFrame:
    return journals.revalidation_counts(_revalidated(spark, sf))


def _said(sentence: str, *values: str) -> str:
    """A sentence with blanks, in SQL."""
    parts = sentence.split("{}")
    return " || ".join([f"'{parts[0]}'", *(x for v, p in zip(values, parts[1:], strict=True) for x in (v, f"'{p}'"))])


def _listed_sql(rows: list[tuple[str, str]]) -> str:
    """Those sentences whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN {sentence} END" for sentence, when in rows) + "], lambda x: x IS NOT NULL)"


_Z = "CAST(zone AS VARCHAR) || '区'"
_ZH_REASONS = f"""list_concat(list_concat(list_transform(list_filter(es, lambda c: c.official AND c.catalog = 'cssci'), lambda c: {_said(reasons.ZH_CSSCI, "'（' || c.edition || '）'")}), list_transform(list_filter(es, lambda c: c.official AND c.catalog = 'cn_core'), lambda c: {_said(reasons.ZH_CORE, "c.edition")})),
  list_transform(list_concat(list_filter(es, lambda c: NOT c.official AND c.catalog = 'cssci'), list_filter(es, lambda c: NOT c.official AND c.catalog = 'ref_cssci')), lambda c: {_said(reasons.ZH_REFERENCE, "'（' || c.edition || '）'")}))"""
_ZH_MISSING = f"""list_concat(list_concat(list_transform(list_filter(es, lambda c: c.official AND c.catalog = 'cssci_ext'), lambda c: '{reasons.ZH_EXTENDED_NOT}'), list_transform(list_filter(es, lambda c: NOT c.official AND c.catalog = 'ref_cssci_ext'), lambda c: '{reasons.ZH_REFERENCE_EXTENDED_NOT}')),
  CASE WHEN len(list_filter(es, lambda c: c.catalog = 'cssci' OR (c.official AND c.catalog IN ('cn_core', 'cssci_ext')) OR (NOT c.official AND c.catalog = 'ref_cssci'))) = 0 THEN ['{reasons.ZH_NONE}'] ELSE [] END)"""
_EN_REASONS = _listed_sql([(_said(reasons.EN_RANKED, "qs"), "good"), (_said(reasons.EN_REFERENCE_RANKED, "qs", f"CASE WHEN listed THEN '{reasons.EN_REFERENCE_SSCI}' ELSE '' END"), "hinted"), (_said(reasons.ZONE_GOOD, _Z, "CAST(zone_year AS VARCHAR)"), "inside AND si"), (_said(reasons.ZONE_REFERENCE, _Z), "inside AND NOT si AND maybe")])
_EN_MISSING = _listed_sql([
    (_said(reasons.EN_EMERGING_RANKED), "only_esci AND has_rank AND NOT good"), (_said(reasons.EN_RANKED_NOT_SSCI), "has_rank AND ranked AND NOT good AND NOT only_esci AND NOT hinted"), (_said(reasons.EN_RANK_LOW, "qs"), "has_rank AND NOT ranked AND NOT only_esci"),
    (_said(reasons.EN_EMERGING), "NOT has_rank AND maybe AND NOT si AND esci"), (_said(reasons.EN_NO_RANK), "NOT has_rank AND si"), (_said(reasons.EN_REFERENCE_NO_RANK), "NOT has_rank AND NOT si AND maybe AND NOT esci"), (_said(reasons.EN_NOT_FOUND), "NOT has_rank AND NOT (si OR maybe)"),
    (_said(reasons.ZONE_NOT_SSCI, _Z), "inside AND NOT (si OR maybe)"), (_said(reasons.ZONE_LOW, _Z), "zone IS NOT NULL AND NOT inside"), (_said(reasons.ZONE_NONE), "zone IS NULL AND (si OR maybe)"),
])
_REASONS_SQL = f"""{_REVALIDATED_SQL}, en AS (SELECT journal_id, list(struct_pack(catalog := catalog, official := official, edition := CAST(year AS VARCHAR)) ORDER BY load_ord) AS es, bool_or(official AND catalog IN ('ssci_list', 'ssci_jcr') AND ssci_indexed) AS si, bool_or(NOT official AND catalog IN ('ssci_list', 'ssci_jcr', 'ref_jcr', 'ref_ssci')) AS maybe,
  bool_or(NOT official AND catalog = 'ref_ssci') AS listed, bool_or(NOT official AND catalog = 'ref_esci') AND NOT bool_or(NOT official AND catalog = 'ref_ssci') AS esci, NOT bool_or(official AND catalog = 'ssci_jcr') AS byref, bool_or(NOT official AND catalog = 'ref_esci') AND NOT bool_or(NOT official AND catalog IN ('ref_ssci', 'ref_jcr', 'ssci_jcr')) AS no_other,
  arg_min(quartiles, load_ord) FILTER (WHERE official AND catalog = 'ssci_jcr') AS q1, arg_min(quartiles, struct_pack(y := -year, l := load_ord)) FILTER (WHERE NOT official AND catalog IN ('ref_jcr', 'ref_ssci', 'ssci_jcr', 'ref_esci')) AS q2,
  arg_min(struct_pack(z := zone, y := year), struct_pack(r := NOT official, y := -year, l := load_ord)) FILTER (WHERE zone IS NOT NULL) AS zz FROM ce GROUP BY 1),
fa AS (SELECT *, coalesce(q1, q2, []) AS ql, array_to_string(coalesce(q1, q2, []), '/') AS qs, zz.z AS zone, zz.y AS zone_year, byref AND no_other AS only_esci FROM en),
fb AS (SELECT *, len(ql) > 0 AS has_rank, len(list_intersect(ql, ['Q1', 'Q2', 'Q3'])) > 0 AS ranked, coalesce(zone BETWEEN 1 AND 3, false) AS inside FROM fa), fc AS (SELECT *, has_rank AND ranked AND si AND NOT byref AS good FROM fb), fd AS (SELECT *, has_rank AND ranked AND NOT good AND NOT only_esci AND (byref OR maybe) AS hinted FROM fc),
sa AS (SELECT id, status, ve.journal_id IS NULL AS lost, len(list_filter(es, lambda c: NOT c.official)) > 0 AS beside, ve.journal_id IS NOT NULL AND es IS NOT NULL AS told, CASE WHEN language = 'zh' THEN {_ZH_REASONS} ELSE {_EN_REASONS} END AS rs, CASE WHEN language = 'zh' THEN {_ZH_MISSING} ELSE {_EN_MISSING} END AS ms, language FROM ve LEFT JOIN fd ON fd.journal_id = ve.journal_id)"""


@query(f"""WITH {_REASONS_SQL}, sb AS (SELECT id, status, lost, beside, CASE WHEN told THEN rs ELSE [] END AS rs, CASE WHEN told THEN ms WHEN lost THEN ['{reasons.NO_JOURNAL}'] WHEN language = 'zh' THEN ['{reasons.ZH_NONE}'] ELSE ['{reasons.EN_NOT_FOUND}'] END AS ms FROM sa)
SELECT id, array_to_string(rs, '；') AS reasons, array_to_string(ms, '；') AS missing, CASE WHEN lost THEN '{reasons.NO_JOURNAL_NOTE}' ELSE CASE status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in journals.NOTES.items())} END || CASE WHEN status IN ('eligible', 'reference') THEN array_to_string(rs, '；') WHEN status = 'pending' THEN CASE WHEN len(ms) > 0 THEN array_to_string(ms, '；') ELSE '{reasons.TOO_LITTLE}' END ELSE '' END || CASE WHEN status = 'reference' THEN '{reasons.REFERENCE_MORE}' WHEN status = 'eligible' AND beside THEN '{reasons.ELIGIBLE_MORE}' ELSE '' END END AS note FROM sb""")
def h5a_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences behind each paper's standing."""
    found = _revalidated(spark, sf).select("id", "journal_id", "language", "status")
    lists = reasons.entries_of(_catalog_entries(spark, sf).withColumn("edition", F.col("year").cast("string")))
    said = journals.keyed_join(found, lists, "journal_id").select("id", reasons.explain(F.col("language"), F.col("status"), F.col("entries"), has_journal=F.col("journal_id").isNotNull()).alias("s"))
    return said.select("id", F.array_join("s.reasons", "；").alias("reasons"), F.array_join("s.missing", "；").alias("missing"), "s.note")


#: The journals after a change: some renamed, some with their names back, some listed, some entries gone.
_CHANGED_SQL = _REVALIDATED_SQL.replace("lower(c_name) AS name, c_custkey % 13 = 0 AS blacklisted", "CASE WHEN c_custkey % 50 = 9 THEN 'other ' || c_custkey ELSE lower(c_name) END AS name, c_custkey % 13 = 0 OR c_custkey % 50 = 7 AS blacklisted").replace("END AS zone FROM part)", "END AS zone FROM part WHERE p_partkey % 40 <> 5)")


@query(f"WITH {_CHANGED_SQL} SELECT id, journal_id, language, status FROM ve")
def i9_changed_journals(spark: SparkSession, sf: str) -> DataFrame:
    """Papers judged and stored, then only those that a change of journals concerns judged again: the table after it."""
    k, path = F.col("c_custkey"), f"{shared_dir(spark)}/judged-{uuid.uuid4().hex}"
    version = lambda other, listed: table(spark, sf, "customer").select(k.alias("journal_id"), F.when(k % 50 == other, F.concat(F.lit("other "), k.cast("string"))).otherwise(F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("issn"), F.array().cast("array<string>").alias("name_variants"), listed.alias("blacklisted"))
    old, new = version(11, k % 13 == 0), version(9, (k % 13 == 0) | (k % 50 == 7))
    entries = _catalog_entries(spark, sf)
    revalidation.store(revalidation.judge(_papers_to_judge(spark, sf), old, entries), path, 16)
    revalidation.revalidate_changed(spark, path, old, new, entries, entries.where("load_ord % 40 <> 5"), 16)
    return revalidation.load(spark, path).select("id", "journal_id", "language", "status")


@query(f"WITH {_REVALIDATED_SQL} SELECT journal_id IS NOT NULL AS matched, status, count(*) AS n FROM ve GROUP BY 1, 2")
def d20_match_preview(spark: SparkSession, sf: str) -> DataFrame:
    return audit.match_preview(_revalidated(spark, sf))


@query(f"""WITH {_REVALIDATED_SQL}, tg AS (SELECT journal_id, list_sort(list_distinct(list(catalog || ':' || CASE WHEN official THEN 'official' ELSE 'reference' END))) AS tags FROM ce GROUP BY 1), lb AS (SELECT ve.*, CASE WHEN status IN ('eligible', 'reference') THEN CASE status WHEN 'eligible' THEN 'official' ELSE 'reference' END ELSE 'pending' END AS kind, tags FROM ve LEFT JOIN tg ON tg.journal_id = ve.journal_id)
SELECT id, kind, kind = 'official' AS official, coalesce(array_to_string(list_filter(tags, lambda t: ends_with(t, ':' || kind)), ','), '') AS evidence FROM lb""")
def h5b_verification_label(spark: SparkSession, sf: str) -> DataFrame:
    tags = journals.journal_evidence(_catalog_entries(spark, sf)).select("journal_id", "tags")
    rows = _revalidated(spark, sf).join(tags, "journal_id", "left").select("id", journals.verification_label(F.col("status"), F.col("basis"), F.col("tags")).alias("v"))
    return rows.select("id", F.col("v.status").alias("kind"), "v.official", F.array_join(F.transform("v.evidence", lambda t: F.concat_ws(":", t["type"], t["kind"])), ",").alias("evidence"))


@query(f"WITH {_REVALIDATED_SQL} SELECT id AS paper_id, old_status AS status, status AS now, status <> old_status AS changed FROM ve")
def h5b_changed_since(spark: SparkSession, sf: str) -> DataFrame:
    found = materialize(_revalidated(spark, sf).select("id", "old_status", "status"), "judged")  # read twice, judged once
    return journals.changed_since(found.select(F.col("id").alias("paper_id"), F.col("old_status").alias("status")), found.select("id", "status"))


@query(f"WITH {_EVIDENCE_SQL} SELECT c_custkey AS journal_id, coalesce(verified, false) AS verified, coalesce(ssci, false) AS ssci_confirmed, NOT (coalesce(verified, false) = (c_custkey % 2 = 0) AND coalesce(ssci, false) = (c_custkey % 3 = 0)) AS changed FROM customer LEFT JOIN ev ON journal_id = c_custkey")
def h5c_reconcile_flags(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "customer").select(F.col("c_custkey").alias("journal_id"), (F.col("c_custkey") % 2 == 0).alias("verified"), (F.col("c_custkey") % 3 == 0).alias("ssci_confirmed"))
    return journals.reconcile_flags(j, journals.journal_evidence(_catalog_entries(spark, sf))).select("journal_id", "verified", "ssci_confirmed", "changed")


@query(f"""WITH {_REVALIDATED_SQL}, w AS (SELECT DISTINCT p_partkey % 90 AS k FROM part WHERE p_size = 7) SELECT count(*) AS papers, count(*) FILTER (WHERE status <> old_status) AS changed FROM ve WHERE journal_id IN (SELECT k FROM w)""")
def i17_listed_journals(spark: SparkSession, sf: str) -> DataFrame:
    """A change of the lists concerns the papers of the journals it names."""
    listed = table(spark, sf, "part").where("p_size = 7").select((F.col("p_partkey") % 90).alias("journal_id")).distinct()
    return journals.revalidation_counts(_revalidated(spark, sf).join(listed, "journal_id", "left_semi")).select("papers", "changed")


@query(f"""WITH {_CATALOG_ENTRIES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY journal_id, catalog ORDER BY official DESC, year DESC, load_ord DESC) AS k FROM ce), m AS (SELECT journal_id, max(CASE WHEN NOT official AND catalog <> 'ref_jcr' THEN load_ord END) AS r, max(CASE WHEN catalog IN ('ssci_list', 'ssci_jcr') AND NOT ssci_indexed THEN load_ord END) AS c FROM ce GROUP BY 1)
SELECT b.journal_id, catalog, load_ord, CASE WHEN catalog IN ('ssci_list', 'ssci_jcr') AND coalesce(c >= load_ord, false) THEN false ELSE ssci_indexed END AS ssci_indexed FROM b JOIN m ON m.journal_id = b.journal_id WHERE k = 1 AND (catalog <> 'ref_jcr' OR r IS NULL OR r < load_ord)""")
def e6_sibling_effects(spark: SparkSession, sf: str) -> DataFrame:
    return journals.sibling_effects(_catalog_entries(spark, sf)).select("journal_id", "catalog", "load_ord", "ssci_indexed")


@query(f"""WITH {_CATALOG_ENTRIES_SQL}, x AS (SELECT load_ord, official, year, lag(official) OVER w AS o, lag(year) OVER w AS y FROM ce WINDOW w AS (PARTITION BY journal_id ORDER BY load_ord)) SELECT load_ord, o IS NULL OR official OR (NOT o AND year >= y) AS writes FROM x""")
def e7_may_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    before = Window.partitionBy("journal_id").orderBy("load_ord")
    rows = _catalog_entries(spark, sf).withColumns({"o": F.lag("official").over(before), "y": F.lag("year").over(before)})
    return rows.select("load_ord", journals.may_overwrite(F.col("official"), F.col("year"), F.col("o"), F.col("y")).alias("writes"))


@query("""WITH s AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS issn, p_name FROM part), k AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS issn FROM customer) SELECT p_partkey FROM s WHERE issn NOT IN (SELECT issn FROM k)""")
def a30_seed_journals(spark: SparkSession, sf: str) -> DataFrame:
    code = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("journal_id"), F.col("c_name").alias("name"), code("c_custkey").alias("issn"))
    seeds = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), code("p_partkey").alias("issn"))
    return journals.seed_journals(known, seeds)[0].select("p_partkey")


@query("""SELECT p_brand AS catalog, max_by(p_size, p_partkey) AS edition, max(p_partkey) AS "at", count(*) AS loads FROM part GROUP BY 1""")
def a31_catalog_loads(spark: SparkSession, sf: str) -> DataFrame:
    loads = table(spark, sf, "part").select(F.col("p_brand").alias("catalog"), F.col("p_size").alias("edition"), F.lit(1).alias("rows"), F.col("p_partkey").alias("at"), F.col("p_partkey").alias("load_id"))
    return journals.load_registry(loads).select("catalog", "edition", "at", "loads")


@query(f"""WITH {_REVALIDATED_SQL}, n2 AS (SELECT ve.id, ve.status, CASE ve.status WHEN 'eligible' THEN '期刊条件满足（官方目录已核验）：' WHEN 'reference' THEN '参考候选（非官方目录）：official list' WHEN 'excluded' THEN '该刊在你的排除名单中，不会进入简报。' ELSE '期刊条件暂不能确认：' || CASE WHEN ve.journal_id IS NULL THEN 'journal' WHEN ve.language = 'zh' THEN 'chinese list' WHEN coalesce(rv.esci_only, false) THEN 'emerging list only' WHEN NOT coalesce(rv.ssci, false) THEN 'ssci' ELSE 'rank' END END AS note FROM ve JOIN rv ON rv.id = ve.id)
SELECT id, note, id % 2 = 0 OR note <> '期刊条件暂不能确认：ssci' AS changed FROM n2""")
def h5d_refresh_notes(spark: SparkSession, sf: str) -> DataFrame:
    judged = materialize(_revalidated(spark, sf).select("id", "status", "missing"), "judged")  # read twice, judged once
    before = judged.where("id % 2 = 1").select("id", F.lit("期刊条件暂不能确认：ssci").alias("note"))
    return journals.refresh_notes(judged, before)[0]


@query(f"""WITH {PAPERS_SQL}, a AS (SELECT *, id % 4 = 0 AS picked, row_number() OVER (PARTITION BY journal_id ORDER BY id % 4 = 0, discovery_date DESC, id) AS n FROM p) SELECT id, journal_id, '{TODAY}' AS last_picked FROM a ORDER BY n > 1, picked, discovery_date DESC, id LIMIT 40""")
def e9_stamped_picks(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "journal_id", "discovery_date")
    return select.first_per_journal(p, "journal_id", F.col("id") % 4 == 0, F.col("discovery_date"), "id", 40, TODAY).select("id", "journal_id", "last_picked")


@query("""WITH r AS (SELECT 'p' || p_partkey AS subject, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 END AS d, CASE WHEN p_partkey % 4 = 0 THEN 'p' || (p_partkey % 20) END AS linked FROM part),
s AS (SELECT 'p' || p_partkey AS subject, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 50 END AS d, 's' || p_size AS state, p_partkey AS t FROM part WHERE p_partkey % 5 <> 0),
o AS (SELECT subject, arg_max(state, t) AS v FROM s GROUP BY 1), e AS (SELECT d, arg_max(state, t) AS v FROM s WHERE d IS NOT NULL GROUP BY 1)
SELECT r.subject, linked, coalesce(l.v, e.v, o.v) AS state FROM r LEFT JOIN o l ON l.subject = linked LEFT JOIN e ON e.d = r.d LEFT JOIN o ON o.subject = r.subject""")
def c18_reading_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    subject, doi = F.concat(F.lit("p"), k.cast("string")), lambda ok: F.when(ok, F.concat(F.lit("10.1000/"), (k % 50).cast("string")))
    p = table(spark, sf, "part")
    rows = p.select(subject.alias("subject"), doi(k % 3 == 0).alias("doi"), F.when(k % 4 == 0, F.concat(F.lit("p"), (k % 20).cast("string"))).alias("linked"))
    states = p.where("p_partkey % 5 <> 0").select(subject.alias("subject"), doi(k % 2 == 0).alias("doi"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("state"), k.alias("at"))
    return library.reading_states(rows, states).select("subject", "linked", "state")


_READING_SQL = ORACLES["c18_reading_states"]


@query(_READING_SQL)
def c18_stream_states(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from two streams, each landed in parts; a row of each from far ahead ends the windows of all others."""
    k, p, path = F.col("p_partkey"), table(spark, sf, "part"), f"{shared_dir(spark)}/reading-{uuid.uuid4().hex}"
    subject, doi, when = F.concat(F.lit("p"), k.cast("string")), lambda ok: F.when(ok, F.concat(F.lit("10.1000/"), (k % 50).cast("string"))), F.timestamp_seconds(k + 1_000_000_000)
    picks = p.select(subject.alias("subject"), doi(k % 3 == 0).alias("doi"), F.when(k % 4 == 0, F.concat(F.lit("p"), (k % 20).cast("string"))).alias("linked"), when.alias("picked_at"))
    states = p.where("p_partkey % 5 <> 0").select(subject.alias("subject"), doi(k % 2 == 0).alias("doi"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("state"), when.alias("at"))
    last = spark.range(1).select(F.lit("ahead").alias("subject"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("linked"), F.lit("x").alias("state"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("at"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("picked_at"))
    streams = []
    for name, rows in (("picks", picks), ("states", states)):
        rows.repartition(2, "subject").write.parquet(f"{path}/{name}")
        last.select(rows.columns).write.mode("append").parquet(f"{path}/{name}")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{path}/{name}"))
    for _ in range(2):  # a second look, when all windows have ended
        reading.keep_rows(reading.reading_rows(*streams, window="3000 days", late="1 day"), f"{path}/joined", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.schema("subject string, linked string, place int, state string, at timestamp").parquet(f"{path}/joined")
    return reading.current_states(rows.where("subject <> 'ahead'"))


# --- what is stored between runs ------------------------------------------------------------------------------------

_COMMITTED_SQL = f"""{PAPERS_SQL}, d AS (SELECT *, substr(discovery_date, 1, 7) AS month FROM p),
one AS (SELECT month, id, row_number() OVER (PARTITION BY month ORDER BY citation_count DESC, id) AS rank FROM d), two AS (SELECT month, id, row_number() OVER (PARTITION BY month ORDER BY citation_count, id) AS rank FROM d WHERE month LIKE '%-0%'),
x AS (SELECT month AS run_date, id, CAST(rank AS INTEGER) AS rank FROM two WHERE rank <= 2 AND id % 3 <> 0 UNION ALL SELECT month, id, CAST(rank AS INTEGER) FROM one WHERE rank <= 3 AND NOT month LIKE '%-0%')"""


@query(f"""WITH {_COMMITTED_SQL} SELECT m.run_date, id, rank, status, n FROM (SELECT DISTINCT month AS run_date FROM d) m LEFT JOIN x USING (run_date) LEFT JOIN (SELECT run_date, count(*) AS n FROM x GROUP BY 1) c USING (run_date) JOIN (SELECT run_date, CASE WHEN bool_or(id IS NOT NULL) THEN 'ok' ELSE 'empty' END AS status FROM (SELECT DISTINCT month AS run_date FROM d) LEFT JOIN x USING (run_date) GROUP BY 1) s USING (run_date)""")
def i10_committed_days(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of all days, a second one of some, and one that failed before its row: what readers see."""
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    p = views.papers(spark, sf).withColumn("run_date", F.substring("discovery_date", 1, 7))
    best = lambda rows, order, n: rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_date").orderBy(order, "id"))).where(F.col("rank") <= n).select("run_date", "id", "rank", F.lit("new").alias("kind"))
    all_days, some = p.select("run_date"), p.where("run_date like '%-0%'")
    days.commit(best(p, F.col("citation_count").desc(), 3), all_days, path, "2001-08-02T01")
    days.commit(best(some, F.col("citation_count"), 2).where("id % 3 <> 0"), some.select("run_date"), path, "2001-08-02T02")
    days.write_items(best(p, F.col("id"), 5), path)  # and there it ended
    seen = days.runs(spark, path).select("run_date", "status", F.when(F.col("items") > 0, F.col("items")).alias("n"))
    return seen.join(days.items(spark, path).select("run_date", "id", "rank"), "run_date", "left").select("run_date", "id", "rank", "status", "n")


@query("""SELECT k AS part, CASE WHEN k = 2 THEN 2 ELSE 1 END AS batch, CAST(n AS BIGINT) AS rows, 6 AS first_read, 0 AS second_read, 1 AS third_read, 5 AS third_skipped FROM (SELECT p_partkey % 6 AS k, count(*) + CASE WHEN p_partkey % 6 = 2 THEN 1 ELSE 0 END AS n FROM part GROUP BY 1) AS a""")
def i6_synced_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Six landed files, read, read again with no change, and with one of them changed: the batch each was read in."""
    path, part = f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}", table(spark, sf, "part")
    land = lambda rows: rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").json(f"{path}/landed")
    rows = part.select((F.col("p_partkey") % 6).alias("part"), "p_partkey", "p_name")
    land(rows)

    def apply(files: list[str], batch: int) -> None:
        found = spark.read.schema("p_partkey long, p_name string").json(files).select("*", F.regexp_extract(F.input_file_name(), "part=([0-9]+)", 1).cast("long").alias("part"))
        found.withColumn("batch", F.lit(batch)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/read")

    done = [sync.sync(spark, f"{path}/landed", f"{path}/state", apply, "*.json") for _ in range(2)]
    more = rows.where("part = 2").unionByName(spark.range(1).select(F.lit(2).cast("long").alias("part"), F.lit(-1).cast("long").alias("p_partkey"), F.lit("one more").alias("p_name")))
    land(more)
    done.append(sync.sync(spark, f"{path}/landed", f"{path}/state", apply, "*.json"))
    counts = {"first_read": done[0].read, "second_read": done[1].read, "third_read": done[2].read, "third_skipped": done[2].files - done[2].read}
    return spark.read.parquet(f"{path}/read").groupBy(F.col("part").cast("long").alias("part")).agg(F.max("batch").alias("batch"), F.count(F.lit(1)).alias("rows")).select("*", *(F.lit(v).alias(k) for k, v in counts.items()))


def _shout(texts: list[str]) -> list[str]:
    return [t[::-1] for t in texts]


@query("""WITH t AS (SELECT doc_id, lang || ' ' || substr(text, 1, 3) AS text FROM documents), k AS (SELECT text, row_number() OVER (ORDER BY min(doc_id), sha256(text)) AS k FROM t WHERE trim(text) <> '' GROUP BY 1) SELECT doc_id, CASE WHEN k <= 70 THEN reverse(t.text) END AS reply, CASE WHEN k <= 70 THEN 'ok' END AS status FROM t LEFT JOIN k USING (text)""")
def j3_model_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Short texts that many rows share, a model that reverses them, and two runs of 35 calls."""
    path = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit(" "), F.substring("text", 1, 3)).alias("text"), F.col("doc_id").alias("priority"))
    calls.work_through(rows, path, _shout, 35, "1")
    return calls.work_through(rows, path, _shout, 35, "2").select("doc_id", "reply", "status")
