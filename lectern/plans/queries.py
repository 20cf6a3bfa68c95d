"""One query for each operator, over views of the test tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, evidence, identifiers, language, topics
from lectern.operators import audit, desk, journals, library, merge, pages, select
from lectern.plans import views
from lectern.plans.views import ENTRIES_SQL, JUDGED_SQL, LOG_SQL, PAPERS_SQL, TODAY
from lectern.session import placed, shared_dir, table
from lectern.sources import imports, interchange

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOPICS = [
    topics.Topic("the-of", ("thing of the", "there and that"), ("of the", "and the"), excluded=("thon",)),
    topics.Topic("der-die", ("einen und der", "nicht mit der"), ("der", "und die")),
    topics.Topic("la-de", ("que de la", "para los con"), ("de la", "le la", "que de")),
]
SHORT = {"the-of": ("of the", "and the"), "der-die": ("und der", "der die"), "la-de": ("de la", "que la")}
#: How the score below counts one topic's terms, in SQL.
_NORMAL = r"' ' || regexp_replace(regexp_replace(lower(title || ' ' || abstract), '[^a-z0-9 \t\n\x0b\f\r\-]', ' ' || chr(1) || ' ', 'g'), '[ \t\n\x0b\f\r\-]+', ' ', 'g') || ' '"


def _hits_sql(slug: str) -> str:
    return " + ".join(f"CAST(contains(t, ' {w} ') AS INTEGER)" for w in SHORT[slug])


# --- A: sources and sinks -------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT page_id, part, pos FROM (SELECT page_id, string_split_regex(html, '<li>') AS parts FROM pages), unnest(parts) WITH ORDINALITY AS u(part, pos)),
f AS (SELECT page_id, pos, trim(regexp_extract(part, '<a href="([^"]*)"', 1)) AS href, trim(regexp_extract(part, '<a href="[^"]*">([^<]*)<', 1)) AS name FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM f WHERE href <> '')
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, href, name FROM r WHERE n = 1""")
def a9_contents_rows(spark: SparkSession, sf: str) -> DataFrame:
    return imports.toc_articles(table(spark, sf, "pages"), "html", "page_id", "<li>", {"href": '<a href="([^"]*)"', "name": '<a href="[^"]*">([^<]*)<'})


@query("""
WITH r AS (SELECT p_partkey, lower(p_name || ' ' || CASE p_size % 3 WHEN 0 THEN '待核验' WHEN 1 THEN 'To be Verified' ELSE p_type END) AS note, CASE p_size % 4 WHEN 0 THEN 'SSCI；SCIE' WHEN 1 THEN 'SCIE, AHCI' WHEN 2 THEN 'essci' END AS dbs, CASE p_partkey % 3 WHEN 0 THEN 'esci' WHEN 1 THEN 'ssci' ELSE 'cssci' END AS catalog FROM part)
SELECT p_partkey, regexp_matches(note, '待核验|未获|未完成|截图|参考|请勿|待查|pending|unverified|to be verified') AS reference,
  CASE WHEN catalog = 'esci' THEN false WHEN dbs IS NOT NULL THEN regexp_matches(dbs, '(^|[^A-Z])SSCI([^A-Z]|$)') ELSE catalog = 'ssci' END AS ssci, CASE WHEN dbs IS NULL THEN 0 WHEN dbs = 'essci' THEN 1 ELSE 2 END AS n FROM r""")
def a11_reference_rows(spark: SparkSession, sf: str) -> DataFrame:
    p, size = table(spark, sf, "part"), F.col("p_size")
    note = F.when(size % 3 == 0, "待核验").when(size % 3 == 1, "To be Verified").otherwise(F.col("p_type"))
    dbs = F.when(size % 4 == 0, "SSCI；SCIE").when(size % 4 == 1, "SCIE, AHCI").when(size % 4 == 2, "essci")
    catalog = F.when(F.col("p_partkey") % 3 == 0, "esci").when(F.col("p_partkey") % 3 == 1, "ssci").otherwise("cssci")
    rows = p.select("p_partkey", journals.is_reference(F.col("p_name"), note).alias("reference"), journals.index_databases(dbs, catalog).alias("d"))
    return rows.select("p_partkey", "reference", "d.ssci", F.size("d.databases").alias("n"))


@query("""
SELECT p_brand || ' ' || p_type AS map_key, min(p_partkey) AS place, count(*) AS versions, arg_min(p_name, p_partkey) AS p_name, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY 1""")
def a18_mapped_preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    return imports.mapped_preview(rows, F.concat_ws(" ", "p_brand", "p_type"), "p_partkey").select("map_key", "place", "versions", "p_name", "p_size")


@query(f"""
WITH {PAPERS_SQL}, b AS (SELECT id, title, language FROM p WHERE id % 3 <> 0), n AS (SELECT id, reverse(title) AS title, CASE WHEN id % 2 = 0 THEN language END AS language FROM p WHERE id % 3 <> 1)
SELECT coalesce(b.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE b.title END AS title, coalesce(n.language, b.language) AS language,
  CASE WHEN b.id IS NOT NULL AND n.id IS NOT NULL THEN 'updated' WHEN n.id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS change FROM b FULL JOIN n ON b.id = n.id""")
def a21_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "title", "language")
    batch = p.where("id % 3 <> 1").select("id", F.reverse("title").alias("title"), F.when(F.col("id") % 2 == 0, F.col("language")).alias("language"))
    return merge.upsert(p.where("id % 3 <> 0"), batch, "id", {"title": "overwrite", "language": "fill"})


@query("""
WITH l AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment || c_nationkey AS k FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_custkey AS id, c_mktsegment || (c_nationkey + 1) AS k FROM customer WHERE c_custkey % 5 = 0),
h AS (SELECT k, min(id) AS local_id FROM l GROUP BY k), m AS (SELECT i.id AS old_id, local_id FROM i LEFT JOIN h USING (k)), t AS (SELECT max(id) AS top FROM l)
SELECT old_id, local_id AS new_id, true AS known FROM m WHERE local_id IS NOT NULL
UNION ALL SELECT old_id, top + row_number() OVER (ORDER BY old_id), false FROM m, t WHERE local_id IS NULL""")
def a26_id_map(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    local = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", "c_nationkey").alias("key"))
    incoming = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.col("c_nationkey") + 1).alias("key"))
    return interchange.id_map(local, incoming, F.col("key"))


@query(f"""
WITH {PAPERS_SQL} SELECT id, '@article{{p' || id || ',' || chr(10) || '  author = {{' || source || '}},' || chr(10) || CASE WHEN title <> '' THEN '  title = {{' || trim(regexp_replace(title, '[{{}}\\\\\\r\\n]+', ' ', 'g'), ' ') || '}},' || chr(10) ELSE '' END
  || '  journal = {{' || priority || '}},' || chr(10) || '  year = {{' || substr(discovery_date, 1, 4) || '}}' || chr(10) || '}}' AS citation FROM p""")
def a28_citations(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    text = interchange.bibtex(F.concat(F.lit("p"), F.col("id").cast("string")), F.array("source"), F.col("title"), F.col("priority"), F.substring("discovery_date", 1, 4), F.lit(None).cast("string"))
    return p.select("id", text.alias("citation"))


@query(f"""
WITH {PAPERS_SQL}, x AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 4 = 0) AS c FROM p WHERE id % 2 = 0) SELECT n AS "rows", c AS conflicts, n <= 200000 AS accepted FROM x""")
def a27_import_preview(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id")
    return interchange.import_preview(p.where("id % 4 = 0"), p.where("id % 2 = 0"), F.col("id"))


@query("""SELECT event_type AS source, max_by(event_id, ts) AS last_id, count(*) AS loads, max(ts) AS last_at FROM events GROUP BY 1""")
def a31_load_registry(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.max_by("event_id", "ts").alias("last_id"), F.count(F.lit(1)).alias("loads"), F.max("ts").alias("last_at"))


# --- B: filters -----------------------------------------------------------------------------------------------------


@query(f"""WITH {PAPERS_SQL} SELECT id, title, discovery_date FROM p WHERE (contains(lower(title), 'that') OR contains(lower(abstract), 'that')) AND status = 'F' AND language = 'en' ORDER BY discovery_date DESC, id LIMIT 500""")
def b1_paper_search(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    found = p.where(desk.all_of([desk.search(["title", "abstract"], "that"), F.col("status") == "F", F.col("language") == "en"]))
    return found.orderBy(F.col("discovery_date").desc(), "id").limit(500).select("id", "title", "discovery_date")


@query(f"""WITH {PAPERS_SQL} SELECT id, language FROM p WHERE discovery_date BETWEEN '1996-01-01' AND '1999-12-31' AND status <> 'P' AND contains(lower(abstract), 'de ')""")
def b2_library_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    return p.where(desk.all_of([F.col("discovery_date").between("1996-01-01", "1999-12-31"), F.col("status") != "P", desk.search(["abstract"], "de ")])).select("id", "language")


@query(f"""WITH {PAPERS_SQL} SELECT id, language FROM p WHERE language IN ('zh', 'en')""")
def b7_language_scope(spark: SparkSession, sf: str) -> DataFrame:
    return views.papers(spark, sf).where(language.in_scope(F.col("language"))).select("id", "language")


@query(f"""WITH {PAPERS_SQL} SELECT id, discovery_date FROM p WHERE discovery_date >= '2001-01-01' AND status <> 'P'""")
def b9_candidate_window(spark: SparkSession, sf: str) -> DataFrame:
    since = F.date_format(F.date_sub(F.lit(TODAY).cast("date"), 213), "yyyy-MM-dd")
    return views.papers(spark, sf).where((F.col("discovery_date") >= since) & (F.col("status") != "P")).select("id", "discovery_date")


@query(f"""WITH {PAPERS_SQL}, w AS (SELECT id, substr(discovery_date, 1, CASE WHEN id % 3 = 0 THEN 4 WHEN id % 3 = 1 THEN 7 ELSE 10 END) AS v FROM p)
SELECT id, CASE WHEN length(v) = 7 THEN v || '-28' WHEN length(v) = 4 THEN v || '-12-31' ELSE v END AS day FROM w""")
def b11_mixed_window(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    cut = F.when(F.col("id") % 3 == 0, 4).when(F.col("id") % 3 == 1, 7).otherwise(10)
    return p.select("id", dates.window_key(F.substring("discovery_date", F.lit(1), cut)).alias("day"))


@query(f"""WITH {PAPERS_SQL} SELECT id, CASE WHEN trim(abstract) = '' THEN 'metadata' ELSE 'abstract' END AS scope FROM p""")
def b17_evidence_scope(spark: SparkSession, sf: str) -> DataFrame:
    return views.papers(spark, sf).select("id", evidence.evidence_scope(F.lit(None).cast("string"), F.col("abstract")).alias("scope"))


# --- C: joins -------------------------------------------------------------------------------------------------------


@query(f"""WITH {PAPERS_SQL}, {JUDGED_SQL} SELECT id, language FROM p WHERE id NOT IN (SELECT paper_id FROM j WHERE decision = 'muted')""")
def c3_not_muted(spark: SparkSession, sf: str) -> DataFrame:
    muted = views.judged(spark, sf).where("decision = 'muted'").select(F.col("paper_id").alias("id"))
    return select.unseen(views.papers(spark, sf), muted, "id").select("id", "language")


@query(f"""WITH {PAPERS_SQL}, c AS (SELECT c_custkey, c_name, c_acctbal > 0 AS official FROM customer WHERE c_custkey % 4 <> 0)
SELECT id, c_name AS journal, CASE WHEN c_custkey IS NULL THEN 'not matched' WHEN official THEN 'official' ELSE 'reference' END AS verdict FROM p LEFT JOIN c ON c_custkey = journal_id""")
def c4_papers_journals(spark: SparkSession, sf: str) -> DataFrame:
    j = views.journals(spark, sf).where("journal_id % 4 <> 0").select("journal_id", F.col("name").alias("journal"), "official")
    return views.papers(spark, sf).join(j, "journal_id", "left").select("id", "journal", F.when(F.col("journal").isNull(), "not matched").when(F.col("official"), "official").otherwise("reference").alias("verdict"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, lower(c_name) AS name, CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_nationkey * 7 % 10000 AS VARCHAR), 4, '0') END AS issn, 'journal ' || c_custkey AS v FROM customer),
i AS (SELECT issn, min(k) AS j1 FROM c WHERE issn IS NOT NULL GROUP BY 1), n AS (SELECT name, min(struct_pack(a := issn IS NULL, b := k)).b AS j2 FROM c GROUP BY 1), v AS (SELECT v AS name, min(struct_pack(a := issn IS NULL, b := k)).b AS j3 FROM c GROUP BY 1),
w AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '0007' END AS issn0,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Journal ' || o_custkey ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS name0 FROM orders)
SELECT row_id, coalesce(j1, j2, j3) AS journal_id, CASE WHEN j1 IS NOT NULL THEN 'issn' WHEN j2 IS NOT NULL THEN 'name' WHEN j3 IS NOT NULL THEN 'variant' ELSE 'none' END AS matched_by
FROM w LEFT JOIN i ON i.issn = substr(issn0, 1, 4) || '-' || substr(issn0, 5) LEFT JOIN n ON n.name = lower(name0) LEFT JOIN v ON v.name = lower(name0)""")
def c5_journal_match(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_custkey").cast("string")
    issn = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("0007")))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Journal "), key)).otherwise(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0")))
    rows = o.select(F.col("o_orderkey").alias("row_id"), issn.alias("issn"), name.alias("journal_name"))
    return journals.match_journals(rows, views.journals(spark, sf)).select("row_id", "journal_id", "matched_by")


@query("""
WITH t AS (SELECT conv_id AS subject, role AS field, CAST(turn AS VARCHAR) AS target, text FROM conversations), c AS (SELECT DISTINCT conv_id AS subject, role AS field, CAST(turn AS VARCHAR) AS target, sha1(trim(text)) AS f, CASE WHEN conv_id % 2 = 0 THEN 'ok' ELSE 'failed' END AS s FROM conversations WHERE conv_id % 3 <> 0)
SELECT t.subject, t.field, t.target, sha1(coalesce(trim(text), '')) AS fingerprint, CASE WHEN coalesce(trim(text), '') = '' THEN 'unavailable' ELSE coalesce(s, 'missing') END AS status
FROM t LEFT JOIN c ON c.subject = t.subject AND c.field = t.field AND c.target = t.target AND c.f = sha1(coalesce(trim(text), ''))""")
def c12_translation_cache(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("subject"), F.col("role").alias("field"), F.col("turn").cast("string").alias("target"), "text")
    cached = t.where("subject % 3 <> 0").select("subject", "field", "target", identifiers.fingerprint(F.col("text")).alias("fingerprint"), F.when(F.col("subject") % 2 == 0, "ok").otherwise("failed").alias("status")).distinct()
    return library.cache_status(t, cached).select("subject", "field", "target", "fingerprint", "status")


@query(f"""WITH {PAPERS_SQL}, b AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'k' || id END AS dedup_key, '10.1/' || id AS doi FROM p), n AS (SELECT id AS row_id, 'k' || id AS dedup_key, '10.1/' || (id + 1) AS doi FROM p)
SELECT row_id, coalesce(x.id, y.id) AS existing_id FROM n LEFT JOIN b x ON x.dedup_key = n.dedup_key LEFT JOIN b y ON y.doi = n.doi""")
def c6_existing_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id")
    text = F.col("id").cast("string")
    base = p.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("k"), text)).alias("dedup_key"), F.concat(F.lit("10.1/"), text).alias("doi"))
    batch = p.select(F.col("id").alias("row_id"), F.concat(F.lit("k"), text).alias("dedup_key"), F.concat(F.lit("10.1/"), (F.col("id") + 1).cast("string")).alias("doi"))
    return merge.match_existing(batch, base).select("row_id", "existing_id")


# --- D: aggregates --------------------------------------------------------------------------------------------------


@query(f"""WITH {PAPERS_SQL} SELECT source, language, status, count(*) AS n FROM p GROUP BY ALL""")
def d1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counts_by(views.papers(spark, sf), "source", "language", "status")


@query(f"""WITH {JUDGED_SQL} SELECT count(*) FILTER (WHERE decision = 'interested') AS interested, count(*) FILTER (WHERE decision = 'muted') AS muted, count(*) AS total FROM j""")
def d3_judgment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return library.judgment_counts(views.judged(spark, sf))


@query(f"""WITH {LOG_SQL} SELECT source, count(*) AS requests, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, CAST(sum(found) AS BIGINT) AS found, CAST(sum(added) AS BIGINT) AS added, max("at") AS last_at, round(count(*) FILTER (WHERE ok) / count(*), 3) AS success_rate FROM g GROUP BY 1""")
def d4_source_health(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ingest_health(views.log(spark, sf), "source")


@query(f"""WITH {LOG_SQL} SELECT topic, count(*) AS requests, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, CAST(sum(found) AS BIGINT) AS found, CAST(sum(added) AS BIGINT) AS added, max("at") AS last_at, round(count(*) FILTER (WHERE ok) / count(*), 3) AS success_rate FROM g GROUP BY 1""")
def d5_topic_health(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ingest_health(views.log(spark, sf), "topic")


@query(f"""WITH {ENTRIES_SQL} SELECT catalog, count(*) FILTER (WHERE official) AS n_official, count(*) FILTER (WHERE NOT official) AS n_reference, count(DISTINCT journal_id) AS journals FROM n GROUP BY 1""")
def d6_catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.catalog_coverage(views.entries(spark, sf))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    kind = desk.kind_of(F.col("discovery_date"), TODAY, F.col("id") % 3 == 0)
    return p.select("id", kind.alias("kind"), (F.col("citation_count") % 2 == 0).alias("core"), "language", (F.col("id") % 5 == 0).alias("browsed"), F.round(F.col("citation_count") % 1000 / 1000, 3).alias("score"), dates.date_to_ms(F.col("discovery_date")).alias("date_ms"))


_LISTED_SQL = f"""{PAPERS_SQL}, x AS (SELECT id, CASE WHEN discovery_date = '{TODAY}' THEN 'new' WHEN id % 3 = 0 THEN 'shown' ELSE 'catchup' END AS kind, citation_count % 2 = 0 AS core, language, id % 5 = 0 AS browsed, round(citation_count % 1000 / 1000, 3) AS score,
  epoch_ms(CAST(CASE WHEN discovery_date LIKE '%-01-01' THEN substr(discovery_date, 1, 4) || '-07-01' ELSE discovery_date END AS TIMESTAMP)) AS date_ms FROM p)"""


@query(f"""WITH {_LISTED_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'new') AS n_new, count(*) FILTER (WHERE kind = 'catchup') AS n_catchup, count(*) FILTER (WHERE kind = 'shown') AS n_shown, count(*) FILTER (WHERE core) AS n_core, count(*) FILTER (WHERE NOT core) AS n_cross, count(*) FILTER (WHERE language NOT IN ('zh', 'en')) AS outside_scope FROM x""")
def d7_discovery_counts(spark: SparkSession, sf: str) -> DataFrame:
    return desk.discovery_counts(_listed(spark, sf))


_MESSAGES = ("Request timed out", "429 Too Many Requests", "Unexpected token < in JSON", "HTTP error", "connect ECONNRESET", "odd")
_STATUSES = (0, 429, 200, 503, 0, 0)


@query(f"""WITH {LOG_SQL}, c AS (SELECT source, topic, "at", id, CASE found % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'throttled' WHEN 2 THEN 'parse' WHEN 3 THEN 'http' WHEN 4 THEN 'network' ELSE 'unknown' END AS cause FROM g WHERE NOT ok),
r AS (SELECT *, row_number() OVER (PARTITION BY source, topic ORDER BY "at", id) > 1 AS again FROM c)
SELECT source, cause, count(*) AS n, min("at") AS first_at, count(*) FILTER (WHERE again) AS retried FROM r GROUP BY 1, 2""")
def d22_failure_causes(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.pmod("found", F.lit(6)) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    return audit.failure_causes(views.log(spark, sf), identifiers.classify_failure(pick(_MESSAGES), pick(_STATUSES)))


@query("""SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS keep FROM orders GROUP BY 1 HAVING count(*) > 1""")
def d11_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_groups(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", "o_orderkey")


@query(f"""WITH {LOG_SQL}, u AS (SELECT "at", CASE WHEN ok THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS tokens FROM g) SELECT strftime("at", '%Y-%m-%d') AS day, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE tokens IS NULL) AS unknown FROM u GROUP BY 1""")
def d12_usage_by_day(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.when(F.col("ok"), F.get_json_object("props", "$.k").cast("long"))
    return audit.usage_by_day(views.log(spark, sf).select("at", tokens.alias("tokens")))


@query("""
WITH r AS (SELECT l_orderkey AS key, l_linenumber * 100000000 + l_partkey * 1000 + CAST(l_quantity AS INTEGER) AS ord, CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE l_returnflag || '-' || l_linestatus END AS pages, repeat('x', CAST(l_quantity AS INTEGER)) AS title, l_tax > 0.07 AS oa, CAST(floor(l_extendedprice) AS BIGINT) AS cites, [CAST(l_suppkey AS VARCHAR)] AS sources FROM lineitem)
SELECT key, arg_min(pages, ord) FILTER (WHERE pages <> 'n/a') AS pages, max(title) AS title, bool_or(oa) AS oa, nullif(max(cites), 0) AS cites, count(*) AS merged,
  array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(list(sources[1])), lambda s: {'o': list_position(list(sources[1] ORDER BY ord), s), 's': s})), lambda e: e.s), 1, 3), ',') AS sources FROM r GROUP BY key""")
def d14_merge(spark: SparkSession, sf: str) -> DataFrame:
    li = placed(table(spark, sf, "lineitem"))
    quantity = F.rint("l_quantity").cast("int")
    o = F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + quantity
    pages = F.when(F.col("l_returnflag") == "N", "n/a").otherwise(F.concat("l_returnflag", F.lit("-"), "l_linestatus"))
    rows = li.select(
        F.col("l_orderkey").alias("key"), F.struct(F.coalesce(o, F.lit(2**63 - 1)).alias("o"), "place").alias("ord"), F.when(o.isNotNull(), pages).alias("pages"), F.repeat(F.lit("x"), quantity).alias("title"), (F.col("l_tax") > 0.07).alias("oa"),
        F.when(F.col("l_tax").isNotNull(), 1).alias("taxed"), F.floor("l_extendedprice").alias("cites"), F.array_compact(F.array(F.col("l_suppkey").cast("string"))).alias("sources"),
    )
    merged = merge.merge_records(rows, "key", "ord", {"pages": "value", "title": "longest", "oa": "any", "taxed": "max", "cites": "max", "sources": "union:3"})
    return merged.withColumn("oa", F.when(F.col("taxed") == 1, F.col("oa"))).withColumn("sources", F.array_join("sources", ",")).drop("taxed")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE trim(text) <> '') AS with_text, count(*) FILTER (WHERE lang IS NOT NULL) AS with_lang FROM documents""")
def d19_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return audit.completeness_counts(table(spark, sf, "documents"), "text", "lang")


@query(f"""WITH {LOG_SQL} SELECT source, max("at") AS last_check, max(CASE WHEN ok THEN "at" END) AS last_ok, arg_max(status, "at") AS last_status, CAST(sum(added) AS BIGINT) AS added, min("at") AS first_seen FROM g GROUP BY 1""")
def d21_source_state(spark: SparkSession, sf: str) -> DataFrame:
    return audit.source_state(views.log(spark, sf))


@query(f"""WITH {PAPERS_SQL} SELECT count(*) FILTER (WHERE title IS DISTINCT FROM trim(title)) AS changed_title, count(*) FILTER (WHERE id % 3 = 0) AS changed_language FROM p""")
def d25_changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "title", "language")
    new = p.select("id", F.trim("title").alias("title"), F.when(F.col("id") % 3 != 0, F.col("language")).alias("language"))
    return audit.changed_rows(p, new, "id", "title", "language")


# --- E, F: selection and order --------------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with a score from two short terms of each topic and their freshness, muted ones left out."""
    muted = views.judged(spark, sf).where("decision = 'muted'").select(F.col("paper_id").alias("id"))
    p = select.unseen(views.papers(spark, sf), muted, "id")
    # the matchable text stands behind a barrier, so that it is made once and not for each term
    text = p.withColumn("t", F.explode(F.array(topics.matchable(F.concat_ws(" ", "title", "abstract")))))
    hits = {slug: topics.count_terms(F.col("t"), terms) for slug, terms in SHORT.items()}
    best = F.greatest(*hits.values())
    topic = F.least(F.lit(1.0), best * 0.3 + 0.1)
    fresh = F.when(F.col("discovery_date") >= "2000-01-01", 1.0).otherwise(0.5)
    return text.select("id", "source", "language", "discovery_date", best.alias("hits"), topics.brief_score(topic, fresh, F.length("abstract") > 0).alias("score"))


_SCORED_SQL = f"""{PAPERS_SQL}, {JUDGED_SQL}, k AS (SELECT *, {_NORMAL} AS t FROM p WHERE id NOT IN (SELECT paper_id FROM j WHERE decision = 'muted')),
h AS (SELECT id, source, language, discovery_date, abstract, greatest({", ".join(_hits_sql(s) for s in SHORT)}) AS hits FROM k),
s AS (SELECT id, source, language, discovery_date, hits, round(0.62 * least(1.0, CAST(hits AS DOUBLE) * 0.3 + 0.1) + 0.28 * CASE WHEN discovery_date >= '2000-01-01' THEN 1.0 ELSE 0.5 END + 0.10 * CASE WHEN length(abstract) > 0 THEN 1.0 ELSE 0.0 END, 4) AS score FROM h)"""


@query(f"""WITH {_SCORED_SQL} SELECT id, source, language, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s ORDER BY score DESC, id LIMIT 50""")
def e1_daily_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    best = _scored(spark, sf).orderBy(F.col("score").desc(), "id").limit(50).withColumn("day", F.lit(TODAY))
    return select.rank_numbers(best, "day", "score", "id").select("id", "source", "language", "score", "rank")


@query(f"""WITH {_SCORED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY discovery_date, source ORDER BY score DESC, id) AS n FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY discovery_date ORDER BY n > 2, score DESC, id) AS place FROM a)
SELECT discovery_date, id, source, score, CAST(row_number() OVER (PARTITION BY discovery_date ORDER BY score DESC, id) AS INTEGER) AS rank FROM b WHERE place <= 5""")
def e3_quota_pick(spark: SparkSession, sf: str) -> DataFrame:
    return select.quota_pick(_scored(spark, sf), "discovery_date", "source", "score", "id", 5).select("discovery_date", "id", "source", "score", "rank")


#: The greedy pick as a recursion: a step for each turn and category of a tier's exploration, then one for each place left.
_PICK_SQL = f"""WITH RECURSIVE {PAPERS_SQL}, r AS (SELECT id, substr(discovery_date, 1, 7) AS month, CASE WHEN discovery_date = '{TODAY}' THEN 'new' WHEN id % 3 = 0 THEN 'shown' ELSE 'catchup' END AS kind, language,
    list_filter([CASE WHEN contains(abstract, 'the') THEN 'c1' END, CASE WHEN contains(abstract, 'der') THEN 'c2' END, CASE WHEN contains(abstract, 'la') THEN 'c3' END], lambda x: x IS NOT NULL) AS cats, CAST(round(citation_count % 1000 / 1000, 3) AS DOUBLE) AS score FROM p),
  pool AS (SELECT month, list(struct_pack(id := id, kind := kind, language := language, cats := cats, score := score) ORDER BY score DESC, id) AS rows FROM r GROUP BY 1),
  f AS (SELECT month, rows, 0 AS step, rows[1:0] AS chosen, rows[1:0] AS lefts, CAST([] AS VARCHAR[]) AS seen, 0 AS n1, 0 AS n2, 0 AS n3 FROM pool
    UNION ALL SELECT month, rows, step + 1, CASE WHEN ix > 0 THEN list_append(chosen, took) ELSE chosen END, CASE WHEN ix > 0 THEN list_concat(now[1:ix - 1], now[ix + 1:]) ELSE now END, CASE WHEN ix > 0 THEN list_append(said, took.language) ELSE said END,
      n1 + CASE WHEN ix > 0 AND list_contains(took.cats, 'c1') THEN 1 ELSE 0 END, n2 + CASE WHEN ix > 0 AND list_contains(took.cats, 'c2') THEN 1 ELSE 0 END, n3 + CASE WHEN ix > 0 AND list_contains(took.cats, 'c3') THEN 1 ELSE 0 END
    FROM (SELECT *, CASE WHEN ix > 0 THEN now[ix] END AS took FROM (SELECT *, CASE WHEN len(chosen) >= 20 OR len(now) = 0 THEN 0
        WHEN s < 6 THEN CASE WHEN [n1, n2, n3][s % 3 + 1] <= s // 3 THEN coalesce(list_position(list_transform(now, lambda x: list_contains(x.cats, 'c' || (s % 3 + 1))), true), 0) ELSE 0 END
        ELSE list_position(worth, list_max(worth)) END AS ix
      FROM (SELECT *, list_transform(now, lambda x: x.score - CAST(0.035 AS DOUBLE) * (CASE WHEN len(x.cats) > 0 THEN least(CASE WHEN list_contains(x.cats, 'c1') THEN n1 ELSE 9999 END, CASE WHEN list_contains(x.cats, 'c2') THEN n2 ELSE 9999 END, CASE WHEN list_contains(x.cats, 'c3') THEN n3 ELSE 9999 END) ELSE len(chosen) END) + CAST(0.10 AS DOUBLE) * (CASE WHEN list_contains(said, x.language) THEN 0 ELSE 1 END)) AS worth
      FROM (SELECT *, step % 26 AS s, CASE WHEN step % 26 = 0 THEN list_filter(rows, lambda x: x.kind = ['new', 'catchup', 'shown'][step // 26 + 1]) ELSE lefts END AS now, CASE WHEN step % 26 = 0 THEN CAST([] AS VARCHAR[]) ELSE seen END AS said FROM f WHERE step < 78))))),
  o AS (SELECT month AS day, unnest(chosen) AS c, generate_subscripts(chosen, 1) AS rank FROM f WHERE step = 78)
SELECT day, c.id AS id, c.kind AS kind, c.language AS language, array_to_string(c.cats, ',') AS category_ids, c.score AS score, rank FROM o"""


@query(_PICK_SQL)
def e4_diverse_pick(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    categories = F.filter(F.array(*(F.when(F.contains("abstract", F.lit(w)), c) for c, w in (("c1", "the"), ("c2", "der"), ("c3", "la")))), lambda c: c.isNotNull())
    rows = p.select("id", F.substring("discovery_date", 1, 7).alias("month"), desk.kind_of(F.col("discovery_date"), TODAY, F.col("id") % 3 == 0).alias("kind"), "language", categories.alias("category_ids"), F.round(F.col("citation_count") % 1000 / 1000, 3).alias("score"))
    return select.diverse_pick(rows, "month", ["c1", "c2", "c3"], 20).withColumn("category_ids", F.array_join("category_ids", ","))


@query(f"""WITH {ENTRIES_SQL} SELECT journal_id, arg_max(quartile, struct_pack(a := official, b := year, c := load_ord)) AS quartile FROM n GROUP BY 1""")
def e5_best_entry(spark: SparkSession, sf: str) -> DataFrame:
    return journals.best_entry(views.entries(spark, sf), "quartile")


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY journal_id, catalog ORDER BY official DESC, year DESC, load_ord DESC) AS k FROM n) SELECT journal_id, catalog, official, year, load_ord, quartile FROM r WHERE k = 1""")
def e6_apply_entries(spark: SparkSession, sf: str) -> DataFrame:
    return journals.apply_entries(views.entries(spark, sf))


@query(f"""WITH {PAPERS_SQL}, a AS (SELECT *, id % 4 = 0 AS picked, row_number() OVER (PARTITION BY journal_id ORDER BY id % 4 = 0, discovery_date DESC, id) AS n FROM p) SELECT id, journal_id, discovery_date FROM a ORDER BY n > 1, picked, discovery_date DESC, id LIMIT 40""")
def e9_first_per_journal(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "journal_id", "discovery_date")
    return select.first_per_journal(p, "journal_id", F.col("id") % 4 == 0, F.col("discovery_date"), "id", 40)


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS run_date FROM orders) SELECT strftime(run_date, '%Y-%m-%d') AS run_date, CAST(greatest(date_diff('day', lag(run_date) OVER (ORDER BY run_date), run_date) - 1, 0) AS INTEGER) AS missed FROM d""")
def e10_missed_days(spark: SparkSession, sf: str) -> DataFrame:
    return select.missed_days(table(spark, sf, "orders"), "o_orderdate").select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), F.greatest(F.coalesce("missed", F.lit(0)), F.lit(0)).alias("missed"))


@query(f"""WITH {_LISTED_SQL} SELECT id, kind, core, browsed, score FROM x ORDER BY core DESC, browsed, CASE kind WHEN 'new' THEN 0 WHEN 'catchup' THEN 1 ELSE 2 END, score DESC, date_ms DESC, id LIMIT 25 OFFSET 25""")
def f1_discovery_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listed(spark, sf)
    return desk.page(rows, desk.discovery_order(rows), 2, 25).select("id", "kind", "core", "browsed", "score")


@query(f"""WITH {_LISTED_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY core DESC, browsed, CASE kind WHEN 'new' THEN 0 WHEN 'catchup' THEN 1 ELSE 2 END, score DESC, date_ms DESC, id) AS rank FROM x) SELECT id, kind, score, rank, CAST(ceil(rank / 10) AS BIGINT) AS page FROM o""")
def f2_stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole list in pages of ten, each of which read_page() gives from one folder."""
    rows, path = _listed(spark, sf), f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages.store_pages(rows, desk.discovery_order(rows), path, 10, parts=8)
    return spark.read.parquet(path).select("id", "kind", "score", "rank", "page")


@query(f"""WITH {PAPERS_SQL}, a AS (SELECT * FROM p WHERE status = 'F' ORDER BY discovery_date DESC, id LIMIT 2000) SELECT id, citation_count FROM a ORDER BY citation_count DESC, id LIMIT 100""")
def f3_qualified_list(spark: SparkSession, sf: str) -> DataFrame:
    newest = views.papers(spark, sf).where("status = 'F'").orderBy(F.col("discovery_date").desc(), "id").limit(2000)
    return newest.orderBy(F.col("citation_count").desc(), "id").limit(100).select("id", "citation_count")


# --- G: sets --------------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT 'b' || item_id AS subject, CASE WHEN item_id % 2 = 0 THEN 'doi:10.1000/' || item_id END AS k, 0 AS stream FROM benchmark UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'doi:10.1000/' || p_partkey END, 1 FROM part),
r AS (SELECT coalesce(k, subject) AS reading_key, subject, stream, row_number() OVER (PARTITION BY coalesce(k, subject) ORDER BY stream, subject) AS n FROM a WHERE subject NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 7 = 0))
SELECT reading_key, subject, CAST(stream AS INTEGER) AS stream FROM r WHERE n = 1""")
def g3_union_streams(spark: SparkSession, sf: str) -> DataFrame:
    b, p = table(spark, sf, "benchmark"), table(spark, sf, "part")
    doi = lambda c, ok: F.when(ok, F.concat(F.lit("https://doi.org/10.1000/"), c.cast("string")))
    first = b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("subject"), doi(F.col("item_id"), F.col("item_id") % 2 == 0).alias("doi"))
    subject = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    second = p.select(subject.alias("subject"), doi(F.col("p_partkey"), F.col("p_partkey") % 3 == 0).alias("doi"))
    return library.union_streams(first, second, p.where("p_partkey % 7 = 0").select(subject.alias("subject")))


# --- H: scalar functions --------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 4 THEN '10.' || (1000 + doc_id % 8000) || '/' || source || '.' || doc_id END AS doi FROM documents""")
def h1a_normalize_doi(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    body = F.concat(F.lit("10."), (F.col("doc_id") % 8000 + 1000).cast("string"), F.lit("/"), F.upper("source"), F.lit("."), F.col("doc_id").cast("string"))
    raw = F.element_at(F.array(F.concat(F.lit(" https://doi.org/"), body), F.concat(F.lit("DOI: "), body, F.lit(").")), F.concat(F.lit("http://dx.doi.org/"), body, F.lit(";")), body, F.replace(body, F.lit("10."), F.lit("11."))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", identifiers.normalize_doi(raw).alias("doi"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || 'X' END AS issn FROM customer""")
def h1b_normalize_issn(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit("issn "), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" - "), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.when(F.col("c_custkey") % 3 != 0, "x").otherwise(""))
    return c.select("c_custkey", identifiers.normalize_issn(raw).alias("issn"))


_TITLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(%s, '<[^>]+>', ' ', 'g'))), '[，。、；：？！“”‘’（）【】《》〈〉·—…,.;:?!"''()\[\]{}<>_/\\|~`@#$%%^&*+=-]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[ \t\n\r\f\x0b\x{a0}]+', ' ', 'g'))"""
_TITLES_SQL = f"""WITH {PAPERS_SQL} SELECT id, {_TITLE % "title"} AS title FROM p"""


@query(_TITLES_SQL)
def h1c_normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    return views.papers(spark, sf).select("id", identifiers.normalize_title(F.col("title")).alias("title"))


@query(_TITLES_SQL)
def h1c_normalize_title_all(spark: SparkSession, sf: str) -> DataFrame:
    return h1c_normalize_title(spark, sf)


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: trim(regexp_replace(replace(replace(x, '&amp;', '&'), '&quot;', '"'), '\s+', ' ', 'g'))), lambda x: length(x) >= 30), '|') AS paragraphs FROM pages""")
def h1h_clean_abstract(spark: SparkSession, sf: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)), identifiers.clean_abstract)
    return table(spark, sf, "pages").select("page_id", F.array_join(found, "|").alias("paragraphs"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN (CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END) WHEN l_linestatus = 'O' THEN l_returnflag ELSE l_returnflag || ' - ' || l_linestatus END AS pages FROM lineitem""")
def h1j_clean_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c, none: F.when(F.col(c) == none, "None").otherwise(F.col(c))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", identifiers.clean_placeholder(F.concat(F.lit(" "), one("l_returnflag", "N"), F.lit(" - "), one("l_linestatus", "O"))).alias("pages"))


@query("""SELECT doc_id, sha1(trim(text)) AS fingerprint FROM documents""")
def h1s_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", identifiers.fingerprint(F.col("text")).alias("fingerprint"))


def _markers(words: tuple[str, ...]) -> str:
    return f"len(list_intersect(list_distinct(w), [{', '.join(repr(x) for x in words)}]))"


@query(f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS w FROM documents), m AS (SELECT doc_id, text, len(w) AS n, {_markers(language.EN_MARKERS)} AS en, {_markers(language.ID_MARKERS)} AS i FROM d)
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'unknown' WHEN i > en AND (i >= 2 OR i / greatest(n, 4) >= 0.34) THEN 'id' WHEN en > i AND (en >= 2 OR en / greatest(n, 4) >= 0.34) THEN 'en' ELSE 'unknown' END AS language,
  CASE WHEN i > en AND (i >= 2 OR i / greatest(n, 4) >= 0.34) THEN (CASE WHEN i >= 3 THEN 'high' ELSE 'medium' END) WHEN en > i AND (en >= 2 OR en / greatest(n, 4) >= 0.34) THEN (CASE WHEN en >= 3 THEN 'high' ELSE 'medium' END) ELSE 'low' END AS confidence FROM m""")
def h2c_detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", language.detect_language(F.col("text"), False).alias("d")).select("doc_id", "d.language", "d.confidence")


def _found_sql(prefix: str, least: int) -> str:
    en, ids, n = f"{prefix}en", f"{prefix}id", f"{prefix}n"
    of = lambda x: f"({x} >= {least} OR {x} / greatest({n}, 4) >= 0.34)"
    return f"CASE WHEN {ids} > {en} AND {of(ids)} THEN 'id' WHEN {en} > {ids} AND {of(en)} THEN 'en' ELSE 'unknown' END"


_RESOLVED_SQL = f"""WITH {PAPERS_SQL}, w1 AS (SELECT id, language AS lang, regexp_extract_all(lower(title), '[a-zà-öø-ÿ]+') AS w, abstract FROM p), w2 AS (SELECT id, lang, len(w) AS tn, {_markers(language.EN_MARKERS)} AS ten, {_markers(language.ID_MARKERS)} AS tid, regexp_extract_all(lower(abstract), '[a-zà-öø-ÿ]+') AS w FROM w1),
w3 AS (SELECT id, lang, tn, ten, tid, len(w) AS an, {_markers(language.EN_MARKERS)} AS aen, {_markers(language.ID_MARKERS)} AS aid FROM w2), v AS (SELECT id, CASE WHEN lang = 'en' THEN 'en' WHEN lang IN ('de', 'fr', 'es') THEN 'other' END AS code, {_found_sql("t", 1)} AS t, tid >= 3 AS sure, {_found_sql("a", 2)} AS a FROM w3)
SELECT id, CASE WHEN id % 4 = 0 THEN 'zh' WHEN code = 'en' AND t = 'id' AND sure THEN 'id' WHEN code IS NOT NULL THEN code WHEN t <> 'unknown' THEN t ELSE a END AS language,
  CASE WHEN id % 4 = 0 THEN 'manual' WHEN code = 'en' AND t = 'id' AND sure THEN 'title' WHEN code IS NOT NULL THEN 'publisher' WHEN t <> 'unknown' THEN 'title' WHEN a <> 'unknown' THEN 'abstract' ELSE 'unknown' END AS source,
  CASE WHEN id % 4 = 0 THEN coalesce(code <> 'zh', false) ELSE coalesce(code = 'en' AND t = 'id' AND sure, false) END AS conflict FROM v"""


@query(_RESOLVED_SQL)
def h2e_resolve_language(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    found = language.resolve_language(F.col("title"), F.col("abstract"), F.col("language"), F.when(F.col("id") % 4 == 0, "ZH"))
    return p.select("id", found.alias("f")).select("id", "f.language", "f.source", "f.conflict")


@query(_RESOLVED_SQL)
def h2e_resolve_language_all(spark: SparkSession, sf: str) -> DataFrame:
    return h2e_resolve_language(spark, sf)


@query("""
WITH c AS (SELECT c_custkey AS journal_id, lower(regexp_replace(c_mktsegment, ' ', '')) || c_nationkey AS clean, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS issn, c_acctbal > 0 AS official FROM customer),
s AS (SELECT *, CASE WHEN issn IS NOT NULL THEN 1000 ELSE 0 END + CASE WHEN official THEN 500 ELSE 0 END + 10 AS score FROM c),
k AS (SELECT clean, arg_max(journal_id, struct_pack(a := score, b := -journal_id)) AS keeper FROM s GROUP BY 1)
SELECT journal_id, keeper FROM s JOIN k USING (clean)""")
def d15_merge_journals(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.concat(F.regexp_replace("c_mktsegment", " ", ""), F.col("c_nationkey").cast("string"))
    rows = c.select(F.col("c_custkey").alias("journal_id"), name.alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).alias("issn"))
    entries = c.select(F.col("c_custkey").alias("journal_id"), F.col("c_mktsegment").alias("catalog"), (F.col("c_acctbal") > 0).alias("official"))
    return journals.merge_duplicate_journals(rows, entries)[0]


@query("""WITH l AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 25) SELECT c_custkey AS journal_id, c_custkey % 2 = 0 OR k IS NOT NULL AS ssci_confirmed, c_custkey % 2 <> 0 AND k IS NOT NULL AS changed FROM customer LEFT JOIN l ON k = c_custkey""")
def h5e_confirm_ssci(spark: SparkSession, sf: str) -> DataFrame:
    code = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    j = table(spark, sf, "customer").select(F.col("c_custkey").alias("journal_id"), code("c_custkey").alias("issn"), (F.col("c_custkey") % 2 == 0).alias("ssci_confirmed"))
    listed = table(spark, sf, "part").where("p_size > 25").select(code("p_partkey").alias("issn"))
    return journals.confirm_ssci(j, listed).select("journal_id", "ssci_confirmed", "changed")


@query(f"""WITH {PAPERS_SQL}, c AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN CAST(id AS DOUBLE) END, c_acctbal) AS value FROM p LEFT JOIN c ON c_custkey = journal_id""")
def a19_enrich(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "journal_id", F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("value"))
    lookup = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("journal_id"), F.col("c_acctbal").alias("value"))
    return imports.enrich(p, lookup, "journal_id", ["value"]).select("id", "value")


@query(f"""WITH {_LISTED_SQL}, t AS (SELECT kind, unnest([language, CASE WHEN core THEN 'core' ELSE 'cross' END]) AS topic FROM x) SELECT topic, count(*) AS n, count(*) FILTER (WHERE kind = 'new') AS n_new FROM t GROUP BY 1""")
def d8_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listed(spark, sf).withColumn("topics", F.array("language", F.when(F.col("core"), "core").otherwise("cross")))
    return desk.topic_counts(rows, "topics")


@query("""SELECT DISTINCT unnest([role, CAST(turn AS VARCHAR)]) AS tag FROM conversations""")
def d18_distinct_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.array("role", F.col("turn").cast("string")).alias("tags"))
    return audit.distinct_tags(rows, "tags")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) < 300 AS allowed FROM events GROUP BY 1""")
def d13_daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    return audit.over_daily_cap(table(spark, sf, "events").select(F.col("ts").alias("at")), 300)


_TITLES = ("书评", "简讯", "勘误", "征文启事", "目录学研究", "Contents of heavy metals in soil", "", "汉语书评的语体研究", "某刊稿约", "A paper")
_NON_RESEARCH_SQL = "|".join(desk.NON_RESEARCH)


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, [{", ".join(f"'{t}'" for t in _TITLES)}][(l_orderkey + l_linenumber) % 10 + 1] AS t, l_linenumber % 3 = 0 AS one_page, l_linestatus = 'O' AS nobody FROM lineitem)
SELECT l_orderkey, l_linenumber, t <> '' AND NOT regexp_matches(t, '{_NON_RESEARCH_SQL}') AND NOT (one_page AND nobody) AS research FROM l""")
def b12_research_rows(spark: SparkSession, sf: str) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, _TITLES)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 10 + 1).cast("int"))
    pages = F.concat(F.lit("7-"), F.when(F.col("l_linenumber") % 3 == 0, "7").otherwise("71"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", desk.is_research(title, pages, F.when(F.col("l_linestatus") == "O", " ").otherwise("Ann")).alias("research"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'other' WHEN 'fr' THEN 'other' WHEN 'es' THEN 'other' END AS language FROM documents""")
def h2d_source_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", language.normalize_source_language(F.concat(F.upper("lang"), F.lit("_XX"))).alias("language"))


@query("""
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 3 AS k FROM orders), v AS (SELECT o_orderkey, CASE k WHEN 0 THEN day WHEN 1 THEN substr(day, 1, 7) ELSE substr(day, 1, 4) END AS value FROM d),
q AS (SELECT *, CASE WHEN value LIKE '%-01-01' OR length(value) = 4 THEN 'year' WHEN length(value) = 7 THEN 'month' ELSE 'day' END AS precision FROM v)
SELECT o_orderkey, value, precision, epoch_ms(CAST(CASE precision WHEN 'year' THEN substr(value, 1, 4) || '-07-01' WHEN 'month' THEN value || '-15' ELSE value END AS TIMESTAMP)) AS ms FROM q""")
def h3a_date_precision(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    value = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), F.when(F.col("o_orderkey") % 3 == 0, 10).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(4))
    rows = o.select("o_orderkey", value.alias("value"))
    return rows.select("o_orderkey", "value", dates.date_precision(F.col("value")).alias("precision"), dates.date_to_ms(F.col("value")).alias("ms"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM events""")
def h3f_local_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", dates.local_day(F.col("ts")).alias("day"))


@query(f"""WITH a AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') AS age FROM orders)
SELECT o_orderkey, CAST(CASE WHEN day LIKE '%-01-01' THEN 0.3 WHEN age < 0 THEN 0.2 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.85 WHEN age <= 90 THEN 0.6 WHEN age <= 365 THEN 0.35 ELSE 0.15 END AS DOUBLE) AS fresh FROM a""")
def h3i_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", dates.freshness_score(F.date_format("o_orderdate", "yyyy-MM-dd"), TODAY).alias("fresh"))


@query(f"""WITH {PAPERS_SQL}, k AS (SELECT id, {_NORMAL} AS t FROM p) SELECT id, CAST({_hits_sql("the-of")} AS INTEGER) AS the_of, CAST({_hits_sql("der-die")} AS INTEGER) AS der_die, CAST({_hits_sql("la-de")} AS INTEGER) AS la_de FROM k""")
def h4a_term_hits(spark: SparkSession, sf: str) -> DataFrame:
    text = views.papers(spark, sf).select("id", F.explode(F.array(topics.matchable(F.concat_ws(" ", "title", "abstract")))).alias("t"))
    return text.select("id", *(topics.count_terms(F.col("t"), terms).alias(slug.replace("-", "_")) for slug, terms in SHORT.items()))


@query()
def h4c_topic_scores(spark: SparkSession, sf: str) -> DataFrame:
    text = views.papers(spark, sf).select("id", F.explode(F.array(topics.matchable(F.concat_ws(" ", "title", "abstract")))).alias("t"))
    scored = text.select("id", topics.topic_scores(F.col("t"), TOPICS).alias("scores"))
    return scored.select("id", *(F.element_at("scores", F.lit(t.slug)).alias(t.slug.replace("-", "_")) for t in TOPICS), F.array_join(topics.top_topics(F.col("scores")), ",").alias("top"))


@query(f"""WITH {PAPERS_SQL}, e AS (SELECT *, citation_count % 2 = 0 AS ssci, 'Q' || (id % 4 + 1) AS q FROM p)
SELECT id, CASE WHEN id % 11 = 0 THEN 'pending' WHEN id % 13 = 0 THEN 'excluded' WHEN language = 'en' AND ssci AND id % 4 < 3 THEN 'eligible' WHEN language = 'en' AND id % 5 = 0 THEN 'reference' ELSE 'pending' END AS status,
  CASE WHEN id % 11 = 0 THEN 'none' WHEN id % 13 = 0 THEN 'blacklist' WHEN language = 'en' AND ssci AND id % 4 < 3 THEN 'official' WHEN language = 'en' AND id % 5 = 0 THEN 'reference' ELSE 'unverified' END AS basis FROM e""")
def h5a_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    p, i = views.papers(spark, sf), F.col("id")
    verdict = journals.eligibility(F.col("language"), i % 11 != 0, i % 13 == 0, F.lit(False), F.lit(False), F.col("citation_count") % 2 == 0, F.lit(False), F.concat(F.lit("Q"), (i % 4 + 1).cast("string")), F.lit(None).cast("int"), i % 5 == 0)
    return p.select("id", verdict.alias("v")).select("id", "v.status", "v.basis")


_EVIDENCE_SQL = r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x, i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?;]*[.!?;]|[^.!?;]+$') AS xs FROM documents), unnest(xs) WITH ORDINALITY AS u(x, i)),
k AS (SELECT doc_id, i, CASE WHEN length(x) > 400 THEN list_transform(range(0, CAST(ceil(length(x) / 300) AS BIGINT)), lambda n: substr(x, n * 300 + 1, 300)) ELSE [x] END AS ps FROM s WHERE length(x) > 1),
e AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i, j) AS c FROM k, unnest(ps) WITH ORDINALITY AS u(p, j))
SELECT doc_id, 'S' || n AS sid, p AS sentence FROM e WHERE c <= 46000"""


@query(_EVIDENCE_SQL)
def h6c_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.build_evidence(table(spark, sf, "documents").select("doc_id", "text"))


@query(_EVIDENCE_SQL)
def h6c_evidence_all(spark: SparkSession, sf: str) -> DataFrame:
    return h6c_evidence(spark, sf)


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%?')), lambda x: NOT contains(substr(text, 1, 500), x))) AS missing FROM documents""")
def h6f_missing_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(evidence.missing_numbers(F.col("text"), F.substring("text", 1, 500))).cast("long").alias("missing"))


@query("""WITH c AS (SELECT conv_id, list(DISTINCT 'S' || turn) AS sids, 'S' || max(turn) || ' S0 S99' AS t, max(turn) AS m FROM conversations GROUP BY 1)
SELECT conv_id, CAST(CASE WHEN m = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_cited, 1 AS n_bogus, round(CASE WHEN m = 0 THEN 1 ELSE 2 END / len(sids), 2) AS coverage FROM c""")
def d24_citation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.concat(F.lit("S"), F.col("turn").cast("string"))).alias("sids"), F.max("turn").cast("string").alias("m"))
    v = c.select("conv_id", evidence.validate_grounding(F.concat(F.lit("see [S"), F.col("m"), F.lit("], [S0] and [S99]")), F.col("sids")).alias("v"))
    return v.select("conv_id", F.size("v.cited").alias("n_cited"), F.size("v.bogus").alias("n_bogus"), "v.coverage")


# --- I: incremental -------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS paper_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS decision, max(ts) AS "at" FROM events GROUP BY 1 HAVING arg_max(event_type, struct_pack(a := ts, b := event_id)) <> 'error'""")
def i12_latest_judgments(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    log = e.select(F.col("user_id").alias("paper_id"), F.when(F.col("event_type") == "error", "cleared").otherwise(F.col("event_type")).alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return library.latest_judgments(log)


@query("""WITH l AS (SELECT event_id // 10 AS action_id, event_type AS kind, user_id AS subject, ts AS "at" FROM events), b AS (SELECT DISTINCT x.action_id, x.kind FROM l x JOIN l y ON x.subject = y.subject AND x.kind = y.kind AND y."at" > x."at")
SELECT DISTINCT action_id, kind FROM l WHERE action_id NOT IN (SELECT action_id FROM b)""")
def i13_undoable(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return library.can_undo(e.select(F.floor(F.col("event_id") / 10).alias("action_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("subject"), F.col("ts").alias("at")))


@query(f"""WITH {PAPERS_SQL} SELECT id, language FROM p WHERE id % 9 = 0""")
def i8_only_changed(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "title", "language")
    before = p.withColumn("title", F.when(F.col("id") % 9 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    scored = before.select("id", F.xxhash64("title", "language", F.lit(TODAY)).alias("content"))
    return merge.only_changed(p, scored, "id", TODAY).select("id", "language")


@query(f"""WITH {LOG_SQL} SELECT topic, CASE WHEN bool_or(ok) THEN 'ok' ELSE 'partial' END AS status, count(*) FILTER (WHERE NOT ok) AS n_failed FROM g GROUP BY 1""")
def i15_run_status(spark: SparkSession, sf: str) -> DataFrame:
    return audit.run_status(views.log(spark, sf), "topic")


@query("""
WITH a AS (SELECT 's' || p_size % 3 AS source_key, p_partkey AS article_id, p_brand || p_size AS dedup_key, p_partkey % 5 <> 0 AS research FROM part), k AS (SELECT source_key, article_id, CASE WHEN article_id % 2 = 0 THEN dedup_key END AS dedup_key FROM a WHERE article_id % 40 = 1 OR article_id % 40 = 2),
f AS (SELECT a.*, x.article_id IS NOT NULL AS known, a.dedup_key IN (SELECT dedup_key FROM k WHERE dedup_key IS NOT NULL) AS stored FROM a LEFT JOIN (SELECT DISTINCT source_key, article_id FROM k) x ON x.source_key = a.source_key AND x.article_id = a.article_id),
m AS (SELECT dedup_key, min(article_id) AS first FROM f WHERE NOT known AND research AND NOT stored GROUP BY 1)
SELECT article_id, CASE WHEN known THEN 'known' WHEN NOT research THEN 'non-research' WHEN stored OR article_id <> first THEN 'duplicate' ELSE 'new' END AS reason FROM f LEFT JOIN m ON m.dedup_key = f.dedup_key""")
def i5_discover_new(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")).alias("source_key"), F.col("p_partkey").alias("article_id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("dedup_key"))
    known = a.where("article_id % 40 = 1 or article_id % 40 = 2").withColumn("dedup_key", F.when(F.col("article_id") % 2 == 0, F.col("dedup_key")))
    return merge.discover_new(a, known, F.col("article_id") % 5 != 0).select("article_id", "reason")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 2 = 0)
SELECT count(*) AS parsed, count(*) FILTER (WHERE b.k IS NULL) AS inserted, count(*) FILTER (WHERE b.s <> n.s) AS updated, count(*) FILTER (WHERE b.s = n.s) AS skipped FROM n LEFT JOIN b ON b.k = n.k""")
def i6_sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    batch = o.where("k % 2 = 0").withColumn("s", F.when(F.col("k") % 3 == 0, "X").otherwise(F.col("s")))
    return merge.sync_counts(o.where("k % 4 <> 0"), batch, "k")


@query(f"""WITH {PAPERS_SQL}, c AS (SELECT user_id AS id, arg_max(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, struct_pack(a := ts, b := event_id)) AS x, max(ts) FROM events GROUP BY 1),
l AS (SELECT user_id AS id, CASE WHEN event_type = 'error' THEN 'auto' ELSE event_type END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT p.id, language AS auto_language, CASE WHEN l.v IS NULL OR l.v = 'auto' THEN language ELSE l.v END AS language, CASE WHEN l.v IS NULL OR l.v = 'auto' THEN 'auto' ELSE 'manual' END AS language_source FROM p LEFT JOIN l ON l.id = p.id AND l.n = 1""")
def h2f_restore_language(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    changes = e.select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("language"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return merge.restore_language(views.papers(spark, sf).select("id", F.col("language").alias("auto_language")), changes)


_HEADING = r"^(The|La|Der|Le) [^.]{1,60}$|^[^ ]+\.$"


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, 0 AS i, CAST([] AS STRUCT(heading VARCHAR, body VARCHAR)[]) AS done, '' AS heading, '' AS body, ls FROM l
  UNION ALL SELECT doc_id, i + 1, CASE WHEN opens AND body <> '' THEN list_append(done, struct_pack(heading := heading, body := body)) ELSE done END, CASE WHEN opens THEN trim(line) ELSE heading END,
    CASE WHEN opens THEN '' WHEN body = '' THEN line ELSE body || chr(10) || line END, ls
  FROM (SELECT *, ls[i + 1] AS line, regexp_matches(ls[i + 1], '{_HEADING}') AND (length(body) > 200 OR len(done) + length(body) = 0) AS opens FROM f WHERE i < len(ls))),
e AS (SELECT doc_id, unnest(list_append(done, struct_pack(heading := heading, body := body))) AS s FROM f WHERE i = len(ls))
SELECT doc_id, s.heading AS heading, length(s.body) AS n_chars FROM e WHERE length(s.body) > 40""")
def h6i_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.explode(evidence.detect_sections(F.col("text"), _HEADING)).alias("s"))
    return d.select("doc_id", "s.heading", F.length("s.text").alias("n_chars"))


@query("""SELECT doc_id, length(text) >= 60 AND 1.0 - length(regexp_replace(text, '[^\\p{L}\\p{N}\\p{P}\\s]', '', 'g')) / length(text) > 0.15 AS garbage, length(text) < 200 AS scanned FROM documents""")
def h6g_text_quality(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", evidence.looks_like_garbage(F.col("text")).alias("garbage"), evidence.looks_scanned(F.length("text"), F.lit(1)).alias("scanned"))


@query("""SELECT doc_id, CAST(ceil(length(text) / 2200) AS INTEGER) AS chunks, length(text) AS n_chars FROM documents""")
def h6b_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = evidence.split_chunks(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(c).alias("chunks"), F.length(F.array_join(c, "")).cast("long").alias("n_chars"))


@query(f"""WITH {PAPERS_SQL} SELECT id, concat_ws('；', CASE WHEN id % 2 = 0 THEN '主题：' || language END, CASE WHEN discovery_date >= '2000-01-01' THEN '近期发表' END, CASE WHEN length(abstract) > 0 THEN '有摘要' END, CASE WHEN status = 'O' THEN '开放获取' END) AS reason FROM p""")
def h4l_reason(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    slugs = F.when(F.col("id") % 2 == 0, F.array("language")).otherwise(F.array().cast("array<string>"))
    return p.select("id", topics.reason(slugs, F.when(F.col("discovery_date") >= "2000-01-01", 1.0).otherwise(0.1), F.length("abstract") > 0, F.col("status") == "O").alias("reason"))
