"""Queries of sources and of the functions that clean records; files are written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, identifiers
from lectern.operators import audit, merge
from lectern.plans import views
from lectern.plans.queries import _TITLE, query
from lectern.plans.views import LOG_SQL, PAPERS_SQL
from lectern.session import shared_dir, table
from lectern.sources import imports, interchange, readers
from lectern.streaming import states
from lectern.streaming.upserts import keyed_table

PAGE = 500  # records of a landed file, about
ENTRIES = 20_000  # of a landed XML file, which one task reads as a whole


def answers(rows: DataFrame, name: str, item: Column, wrap, ident: str = "id") -> str:
    """Landed JSON answers: each file holds one page of items, in the envelope that `wrap` puts around them."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/landed-{name}-{uuid.uuid4().hex}"
    pages = rows.select(F.floor(F.col(ident) / PAGE).cast("long").alias("page"), item.alias("item")).groupBy("page").agg(F.collect_list("item").alias("items"))
    pages.select("page", F.to_json(wrap(F.col("items"))).alias("value")).write.partitionBy("page").text(path)
    return path


def _parts(day: Column, cut: Column) -> Column:
    numbers = F.transform(F.split(day, "-"), lambda x: x.cast("int"))
    return F.struct(F.array(F.slice(numbers, F.lit(1), cut)).alias("date-parts"))


@query(f"""WITH {PAPERS_SQL} SELECT '10.1234/w' || id AS doi, trim(title) AS title, 1 AS n_authors, 'Journal ' || journal_id AS journal_name, lpad(CAST(id % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(journal_id % 10000 AS VARCHAR), 4, '0') AS issn,
  CASE WHEN id % 2 = 0 THEN discovery_date END AS published_online, CASE WHEN id % 3 = 0 THEN substr(discovery_date, 1, 7) END AS published_print, coalesce(CASE WHEN id % 5 = 0 THEN substr(discovery_date, 1, 4) END, CASE WHEN id % 2 = 0 THEN discovery_date END, CASE WHEN id % 3 = 0 THEN substr(discovery_date, 1, 7) END) AS issued_date, citation_count
FROM p WHERE trim(title) <> ''""")
def a1_works(spark: SparkSession, sf: str) -> DataFrame:
    i, day = F.col("id"), F.col("discovery_date")
    item = F.struct(
        F.concat(F.lit("https://doi.org/10.1234/W"), i.cast("string")).alias("DOI"), F.array("title").alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.lit("Lee").alias("family"))).alias("author"), F.array(F.concat(F.lit("Journal "), F.col("journal_id").cast("string"))).alias("container-title"),
        F.array(F.concat(F.lpad((i % 10000).cast("string"), 4, "0"), F.lpad((F.col("journal_id") % 10000).cast("string"), 4, "0"))).alias("ISSN"), F.when(i % 2 == 0, _parts(day, F.lit(3))).alias("published-online"), F.when(i % 3 == 0, _parts(day, F.lit(2))).alias("published-print"), F.when(i % 5 == 0, _parts(day, F.lit(1))).alias("issued"), F.col("citation_count").alias("is-referenced-by-count"),
    )
    path = answers(views.papers(spark, sf), "works", item, lambda items: F.struct(F.struct(items.alias("items")).alias("message")))
    return readers.read_works(spark, path).select("doi", "title", F.size("authors").alias("n_authors"), "journal_name", "issn", "published_online", "published_print", "issued_date", "citation_count")


@query(f"""WITH {PAPERS_SQL} SELECT '10.1234/g' || id AS doi, trim(title) AS title, 'one two one' AS abstract, 'k1,k2' AS keywords, 'A,B' AS authors, 'J' || journal_id AS journal_name, '1234-567X' AS issn, '3-9' AS pages, id % 2 = 0 AS open_access FROM p WHERE trim(title) <> ''""")
def a2_graph(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    named = lambda *names: F.array(*(F.struct(F.struct(F.lit(n).alias("display_name")).alias("author")) for n in names))
    scored = F.array(F.struct(F.lit("k2").alias("display_name"), F.lit(0.2).alias("score")), F.struct(F.lit("k1").alias("display_name"), F.lit(0.9).alias("score")))
    source = F.struct(F.concat(F.lit("J"), F.col("journal_id").cast("string")).alias("display_name"), F.lit("1234567x").alias("issn_l"))
    item = F.struct(
        F.concat(F.lit("https://doi.org/10.1234/g"), i.cast("string")).alias("doi"), "title", F.create_map(F.lit("one"), F.array(F.lit(0), F.lit(2)), F.lit("two"), F.array(F.lit(1))).alias("abstract_inverted_index"), scored.alias("keywords"), named("A", "B").alias("authorships"),
        F.struct(source.alias("source")).alias("primary_location"), F.struct(F.lit("3").alias("first_page"), F.lit("9").alias("last_page")).alias("biblio"), F.struct((i % 2 == 0).alias("is_oa")).alias("open_access"),
    )
    path = answers(views.papers(spark, sf), "graph", item, lambda items: F.struct(items.alias("results")))
    return readers.read_graph(spark, path).select("doi", "title", "abstract", F.array_join("keywords", ",").alias("keywords"), F.array_join("authors", ",").alias("authors"), "journal_name", "issn", "pages", "open_access")


@query(f"""WITH {PAPERS_SQL} SELECT '10.1234/s' || id AS doi, CASE WHEN id % 4 <> 0 THEN discovery_date END AS issued_date FROM p WHERE id % 4 = 0 OR discovery_date BETWEEN '1993-01-01' AND '1997-12-31' ORDER BY CASE WHEN id % 4 <> 0 THEN discovery_date END DESC NULLS LAST, 's' || id LIMIT 80""")
def a3_papers(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.lit("s"), F.col("id").cast("string"))
    item = F.struct(number.alias("paperId"), F.concat(F.lit("t"), number).alias("title"), F.when(F.col("id") % 4 != 0, F.col("discovery_date")).alias("publicationDate"), F.create_map(F.lit("DOI"), F.concat(F.lit("10.1234/"), number)).alias("externalIds"), F.array(F.struct(F.lit("Ann").alias("name"))).alias("authors"))
    path = answers(views.papers(spark, sf), "papers", item, lambda items: F.struct(items.alias("data")))
    return readers.read_papers(spark, path, "1993-01-01", "1997-12-31", 80).select("doi", "issued_date")


@query(f"""WITH {PAPERS_SQL} SELECT 'EJ' || id AS id, CASE id % 4 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'report' WHEN 2 THEN 'dissertation' ELSE 'other' END AS doc_type, substr(discovery_date, 1, 4) AS published_date, CASE WHEN id % 3 = 0 THEN '10.1234/e' || id END AS doi, id % 2 = 0 AS peer_reviewed FROM p""")
def a4_eric(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    kinds = F.element_at(F.array(F.lit("Journal Articles"), F.lit("Reports - Research"), F.lit("Dissertations/Theses"), F.lit("Books")), (i % 4 + 1).cast("int"))
    item = F.struct(F.concat(F.lit("EJ"), i.cast("string")).alias("id"), "title", F.array(kinds).alias("publicationtype"), F.substring("discovery_date", 1, 4).cast("int").alias("publicationdateyear"), F.when(i % 3 == 0, F.concat(F.lit("http://dx.doi.org/10.1234/e"), i.cast("string"))).alias("url"), F.when(i % 2 == 0, "T").otherwise("F").alias("peerreviewed"))
    path = answers(views.papers(spark, sf), "eric", item, lambda items: F.struct(F.struct(items.alias("docs")).alias("response")))
    return readers.read_eric(spark, path).select("id", "doc_type", "published_date", "doi", "peer_reviewed")


@query(f"""WITH {PAPERS_SQL} SELECT lpad(CAST(1000 + id % 9000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(id AS VARCHAR), 5, '0') AS id, 'paper ' || id AS title, discovery_date AS published_date, 'preprint' AS doc_type, 1 AS n_authors FROM p""")
def a5_atom(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.lpad((F.col("id") % 9000 + 1000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("id").cast("string"), 5, "0"))
    rows = views.papers(spark, sf).select(F.concat(F.lit("http://arxiv.org/abs/"), number, F.lit("v2")).alias("id"), F.concat(F.lit("paper\n "), F.col("id").cast("string")).alias("title"), F.lit("a summary").alias("summary"), F.concat("discovery_date", F.lit("T00:00:00Z")).alias("published"), F.array(F.struct(F.lit("Ann Lee").alias("name"))).alias("author"))
    path = f"{shared_dir(spark)}/landed-atom-{uuid.uuid4().hex}"
    rows.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").option("maxRecordsPerFile", ENTRIES).save(path)
    return readers.read_atom(spark, path).select("id", "title", "published_date", "doc_type", F.size("authors").alias("n_authors"))


@query(f"""WITH {PAPERS_SQL} SELECT CAST(id AS VARCHAR) AS id, CASE id % 3 WHEN 0 THEN 'conference-paper' WHEN 1 THEN 'journal-article' ELSE 'other' END AS doc_type, CASE WHEN id % 2 = 0 THEN discovery_date ELSE substr(discovery_date, 1, 4) END AS published_date FROM p""")
def a6_articles(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    item = F.struct(i.cast("string").alias("article_number"), "title", F.element_at(F.array(F.lit("Conferences"), F.lit("Journals"), F.lit("Standards")), (i % 3 + 1).cast("int")).alias("content_type"), F.when(i % 2 == 0, F.col("discovery_date")).otherwise("March 1999").alias("publication_date"), F.substring("discovery_date", 1, 4).alias("publication_year"))
    item = item.withField("content_type", F.when(item["content_type"] == "Conferences", "IEEE Conference").when(item["content_type"] == "Journals", "IEEE Journal").otherwise("Standard"))
    path = answers(views.papers(spark, sf), "articles", item, lambda items: F.struct(items.alias("articles")))
    return readers.read_ieee(spark, path).select("id", "doc_type", "published_date")


_FEED_SQL = "w AS (SELECT 'j' || o_custkey % 40 AS journal, '10.9/' || o_orderkey AS doi, CASE WHEN o_orderkey % 6 <> 0 THEN 'T' || o_orderkey END AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey FROM orders)"


@query(f"""WITH {_FEED_SQL}, f AS (SELECT journal, count(*) AS n FROM w WHERE title IS NOT NULL AND date >= '1997-01-01' AND o_orderkey % 3 <> 0 GROUP BY 1) SELECT w.journal, count(*) AS found, coalesce(max(n), 0) AS inserted FROM w LEFT JOIN f ON f.journal = w.journal GROUP BY 1""")
def a7_feed_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    doi = F.concat(F.lit("10.9/"), F.col("o_orderkey").cast("string"))
    works = o.select(F.concat(F.lit("j"), (F.col("o_custkey") % 40).cast("string")).alias("journal"), F.upper(doi).alias("doi"), F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("T"), F.col("o_orderkey").cast("string"))).alias("title"), F.lit(None).cast("string").alias("abstract"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("url"))
    return imports.feed_status(works, imports.journal_feed(works, "1997-01-01"), o.where("o_orderkey % 3 = 0").select(doi.alias("doi")))


@query(f"""WITH {PAPERS_SQL} SELECT 'k' || id AS key, CASE WHEN id % 2 = 0 THEN 'conference-paper' ELSE 'journal-article' END AS doc_type, 'A title ' || id AS title, 2 AS n_authors, CASE WHEN id % 3 = 0 THEN '2020' ELSE substr(discovery_date, 1, 4) END AS year,
  CASE WHEN id % 3 = 0 THEN '2020' ELSE substr(discovery_date, 1, 4) END || '-03' AS issued_date, CASE WHEN id % 3 = 0 THEN '2020.acl-main.' || id END AS anthology_id FROM p""")
def a8_bibtex(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id").cast("string")
    year = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("  year = "), F.substring("discovery_date", 1, 4), F.lit(",\n")))
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://x.org/2020.acl-main."), i, F.lit("/"))).otherwise("https://x.org/")
    kind = F.when(F.col("id") % 2 == 0, "inproceedings").otherwise("article")
    entry = F.concat(F.lit("@"), kind, F.lit("{k"), i, F.lit(",\n  title = {A {title} "), i, F.lit("},\n  author = \"Lee, Ann and Ray, Bo\",\n"), year, F.lit("  month = mar,\n  url = {"), url, F.lit("}\n}\n"))
    path = f"{shared_dir(spark)}/landed-bib-{uuid.uuid4().hex}"
    views.papers(spark, sf).select(entry.alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_bibtex(spark, path).select("key", "doc_type", "title", F.size("authors").alias("n_authors"), "year", "issued_date", "anthology_id")


@query(r"""SELECT 'k' || doc_id AS key, '2001' AS year, sha256(trim(regexp_replace('of @articlex, title = y' || translate(text, '{}', '()'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS note_sha256 FROM documents WHERE text IS NOT NULL""")
def a8_bibtex_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Plain files, whose entries hold whole texts and lines that look like other entries; they may be cut anywhere."""
    d = table(spark, sf, "documents").where("text is not null")
    entry = F.concat(F.lit("@article{k"), F.col("doc_id").cast("string"), F.lit(",\n  title = {T},\n  year = 2001,\n  note = {of\n@article{x, title = y}"), F.translate("text", "{}", "()"), F.lit("}\n}\n"))
    path = f"{shared_dir(spark)}/landed-bib-{uuid.uuid4().hex}"
    d.select(entry.alias("value")).write.text(path)
    return readers.read_bibtex(spark, path).select("key", "year", F.sha2(F.element_at("fields", F.lit("note")), 256).alias("note_sha256"))


@query("""SELECT p_name AS name, p_brand AS edition, CAST(p_size AS VARCHAR) AS year FROM part""")
def a10_catalog_csv(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_name").alias("刊名 (Name)"), F.col("p_brand").alias("Edition_"), F.col("p_size").alias("年份"))
    path = f"{shared_dir(spark)}/landed-catalog-{uuid.uuid4().hex}"
    interchange.write_csv(rows, path)
    return imports.read_catalog(spark, path, {"name": ("刊名Name", "name"), "edition": ("edition",), "year": ("年份", "year")})


@query("""SELECT p_partkey, 'title ' || p_partkey AS title, 'Ann,Bo' AS authors, p_brand AS journal FROM part""")
def a13_tagged_records(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("RT Journal\nT1 title\n  "), k, F.lit("\nA1 Ann\nA1 Bo\nJF "), F.col("p_brand"), F.lit("\n\nRT Other\nT1 second"))
    found = imports.tagged_records(table(spark, sf, "part").select("p_partkey", text.alias("text")), "text", "p_partkey").where("record = 0")
    of = lambda tag: F.array_join(F.flatten(F.collect_list(F.when(F.col("tag") == tag, F.col("values")))), ",")
    return found.groupBy("p_partkey").agg(of("T1").alias("title"), of("A1").alias("authors"), of("JF").alias("journal"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'On ' || p_partkey END AS title, CASE WHEN p_size % 4 <> 0 THEN '2' END AS n, CASE WHEN p_size % 4 <> 0 THEN '2014' END AS year, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS volume, CASE WHEN p_size % 4 <> 0 THEN '3-9' END AS pages FROM part""")
def a14_citations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("[7] 王一, 李二. On "), k, F.when(F.col("p_size") % 4 != 0, "[J]").otherwise("[M]"), F.lit(". 语言, 2014, "), F.col("p_size").cast("string"), F.lit("(2): 3-9."))
    c = imports.parse_citation(line)
    return table(spark, sf, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.title", F.when(F.col("c").isNotNull(), F.size("c.authors").cast("string")).alias("n"), "c.year", "c.volume", "c.pages")


@query("""SELECT 'T' || p_partkey AS title, '王一|李二' AS authors, p_brand AS journal_name, 'zh' AS language FROM part WHERE p_size % 7 <> 0""")
def a15_delimited_records(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rows = p.select(F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("T"), F.col("p_partkey").cast("string"))).alias("篇名"), F.lit("王一；李二").alias("作者"), F.col("p_brand").alias("刊名"))
    path = f"{shared_dir(spark)}/landed-records-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return imports.read_delimited(spark, path).select("title", F.array_join("authors", "|").alias("authors"), "journal_name", "language")


@query("""WITH a AS (SELECT p_partkey AS k, 0 AS fmt, 2 AS score FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END FROM part) SELECT k, CAST(arg_max(fmt, struct_pack(a := score, b := -fmt)) AS INTEGER) AS fmt FROM a GROUP BY 1""")
def a16_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("A Title "), F.col("p_partkey").cast("string")).alias("title"), "p_size")
    none = F.array().cast("array<string>")
    first = p.select("k", "title", F.lit("x").alias("journal"), F.lit(None).cast("string").alias("doi"), none.alias("authors"), none.alias("keywords"), F.lit(0).alias("fmt"))
    second = p.select("k", F.replace("title", F.lit(" "), F.lit("")).alias("title"), F.lit("x").alias("journal"), F.when(F.col("p_size") % 2 == 0, "10.1/x").alias("doi"), none.alias("authors"), none.alias("keywords"), F.lit(1).alias("fmt"))
    rows = first.unionByName(second)
    return imports.reconcile(rows, F.col("title"), imports.filled_score(["title", "journal", "doi"], "authors", "keywords"), [F.col("fmt")]).select("k", "fmt")


@query("""SELECT 'T' || p_partkey AS title, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END AS n_keywords, CASE WHEN p_size % 2 = 0 THEN 'imported' END AS keywords_source, CASE WHEN p_size % 3 = 0 THEN 'en' ELSE 'zh' END AS language, p_brand AS journal_name FROM part WHERE p_size % 5 <> 0""")
def a17_imported_records(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(F.when(size % 5 != 0, F.concat(F.lit(" T"), F.col("p_partkey").cast("string"))).alias("题名"), F.when(size % 2 == 0, "一，二").alias("关键词"), F.when(size % 3 == 0, "en").alias("language"), F.col("p_brand").alias("来源"))
    return imports.imported_records(rows).select("title", F.size("keywords").alias("n_keywords"), "keywords_source", "language", "journal_name")


@query(f"""WITH {PAPERS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN '10.1/' || id END AS doi, CASE WHEN id % 2 = 0 THEN abstract WHEN id % 3 = 0 AND id % 4 <> 0 THEN 'found' END AS abstract, id % 3 = 0 AND id % 5 = 0 AS open_access, CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 'gold' END AS oa_status, CASE WHEN journal_id % 2 = 0 THEN 'P' || journal_id END AS publisher, journal_id % 4 = 0 AS in_doaj FROM p""")
def a19_fill_access(spark: SparkSession, sf: str) -> DataFrame:
    p, i = views.papers(spark, sf), F.col("id")
    rows = p.select("id", F.when(i % 3 == 0, F.concat(F.lit("10.1/"), i.cast("string"))).alias("doi"), F.col("journal_id").cast("string").alias("issn"), F.when(i % 2 == 0, F.col("abstract")).alias("abstract"))
    locations = p.select(F.concat(F.lit("10.1/"), i.cast("string")).alias("doi"), F.when(i % 5 == 0, "http://x").alias("best_url"), F.lit("gold").alias("oa_status"), F.lit("cc").alias("license"), F.when(i % 4 != 0, "found").alias("abstract"))
    publishers = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("issn"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("publisher"), (F.col("c_custkey") % 4 == 0).alias("in_doaj"))
    return imports.fill_access(rows, locations, publishers).select("id", "doi", "abstract", "open_access", "oa_status", "publisher", "in_doaj")


def _backfill(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p, i = views.papers(spark, sf), F.col("id")
    doi = F.concat(F.lit("10.1/"), i.cast("string"))
    papers = p.select("id", F.when(i % 4 != 0, doi).alias("doi"), F.when(i % 3 == 0, F.array("source")).alias("keywords"), F.when(i % 2 == 0, F.col("abstract")).alias("abstract"))
    found = p.where("id % 7 <> 0").select(doi.alias("doi"), (i % 5 != 0).alias("ok"), F.when(i % 6 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("k"), "language")).alias("keywords"), F.lit("found").alias("abstract"))
    return merge.fill_keywords(papers, found)


@query(f"""WITH {PAPERS_SQL}, b AS (SELECT *, id % 4 <> 0 AND id % 3 <> 0 AS due FROM p), g AS (SELECT *, due AND id % 7 <> 0 AND id % 5 <> 0 AS got FROM b) SELECT id, CASE WHEN got AND id % 6 <> 1 THEN 'k,' || language WHEN id % 3 = 0 THEN source END AS keywords, coalesce(CASE WHEN id % 2 = 0 THEN abstract END, CASE WHEN got THEN 'found' END) AS abstract FROM g""")
def a20_keyword_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return _backfill(spark, sf)[0].select("id", F.array_join("keywords", ",").alias("keywords"), "abstract")


@query(f"""WITH {PAPERS_SQL}, b AS (SELECT *, id % 4 <> 0 AND id % 3 <> 0 AS due FROM p), g AS (SELECT *, due AND id % 7 <> 0 AND id % 5 <> 0 AS got FROM b) SELECT count(*) FILTER (WHERE due) AS checked, count(*) FILTER (WHERE got) AS n_ok, count(*) FILTER (WHERE due AND NOT got) AS n_failed, count(*) FILTER (WHERE got AND id % 6 <> 1) AS with_keywords, count(*) FILTER (WHERE got AND id % 6 = 1) AS without_keywords FROM g""")
def a20_backfill_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _backfill(spark, sf)[1]


@query(f"""WITH {PAPERS_SQL}, b AS (SELECT id, title FROM p WHERE id % 3 <> 0) SELECT coalesce(b.id, n.id) AS id, coalesce(n.title, b.title) AS title, coalesce(b.id * 2, n.id) AS first_seen FROM b FULL JOIN (SELECT id, reverse(title) AS title FROM p WHERE id % 3 <> 1) n ON n.id = b.id""")
def a22_stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf).select("id", "title")
    base, batch = p.where("id % 3 <> 0").withColumn("first_seen", F.col("id") * 2), p.where("id % 3 <> 1").select("id", F.reverse("title").alias("title"), F.col("id").alias("first_seen"))
    return merge.upsert(base, batch, "id", merge.policy_for(base, merge.STREAM_POLICY)).select("id", "title", "first_seen")


@query(f"""WITH {LOG_SQL} SELECT id, source, found, CASE WHEN ok THEN '' ELSE substr(repeat('error ' || id || ' ', 60), 1, 500) END AS message FROM g""")
def a24_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    g = views.log(spark, sf)
    message = F.when(~F.col("ok"), F.repeat(F.concat(F.lit("error "), F.col("id").cast("string"), F.lit(" ")), 60))
    rows = g.withColumns({"message": message, "http_status": F.lit(200), "ms": F.col("id"), "topic": F.col("topic").cast("string")})
    return audit.log_rows(rows.withColumn("found", F.col("found"))).select(F.col("ms").alias("id"), "source", "found", "message")


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def a25_export(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    interchange.export_tables({"customer": table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_name").alias("api_key"))}, path)
    return spark.read.parquet(f"{path}/customer")


@query("""WITH i AS (SELECT c_custkey AS old_id, c_custkey + 100000 AS new_id FROM customer WHERE c_custkey % 3 <> 0) SELECT o_orderkey, new_id AS paper_id FROM orders JOIN i ON i.old_id = o_custkey""")
def a26_remap_children(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 100000).alias("new_id"))
    return interchange.remap_children(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("paper_id")), "paper_id", ids)


@query(f"""WITH {PAPERS_SQL} SELECT id, 'TY  - JOUR' || chr(10) || 'AU  - Ann' || chr(10) || 'AU  - Bo' || chr(10) || 'JO  - J' || journal_id || chr(10) || 'PY  - ' || substr(discovery_date, 1, 4) || CASE WHEN id % 2 = 0 THEN chr(10) || 'DO  - 10.1/' || id ELSE '' END || chr(10) || 'ER  - ' AS citation FROM p""")
def a28_ris(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id").cast("string")
    text = interchange.ris(F.array(F.lit("Ann"), F.lit("Bo")), F.lit(None).cast("string"), F.concat(F.lit("J"), F.col("journal_id").cast("string")), F.substring("discovery_date", 1, 4), F.when(F.col("id") % 2 == 0, F.concat(F.lit("10.1/"), i)))
    return views.papers(spark, sf).select("id", text.alias("citation"))


@query(f"""WITH {PAPERS_SQL}, f AS (SELECT id, CASE WHEN regexp_matches(title, '[",\n]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END AS t FROM p) SELECT id, id || ',' || t || ',"a ""b"", c"' AS line FROM f""")
def a29_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.papers(spark, sf).select("id", "title", F.lit('a "b", c').alias("x"))
    return rows.select("id", interchange.csv_lines(rows).alias("line"))


@query("""WITH b AS (SELECT c_name AS name, c_mktsegment AS note FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS note FROM customer WHERE c_custkey % 3 <> 1) SELECT coalesce(b.name, n.name) AS name, coalesce(n.note, b.note) AS note FROM b FULL JOIN n ON b.name = n.name""")
def a33_watch_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    base = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    batch = c.where("c_custkey % 3 <> 1").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("note"))
    return merge.upsert(base, batch, "name", {"note": "fill"}).select("name", "note")


@query(f"""WITH {PAPERS_SQL} SELECT id AS item_id, CASE WHEN id % 3 = 0 OR id % 3 = 1 THEN id END AS matched_paper_id, CASE id % 3 WHEN 0 THEN 'doi' WHEN 1 THEN 'title' END AS matched_by FROM p""")
def c7_published_links(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    papers = views.papers(spark, sf).select("id", F.concat(F.lit("10.1234/"), i.cast("string")).alias("doi"), F.concat(F.lit("The Study of No. "), i.cast("string")).alias("title"))
    items = papers.select(i.alias("item_id"), F.when(i % 3 == 0, F.concat(F.lit("https://doi.org/"), "doi")).alias("doi"), F.when(i % 3 == 1, F.concat(F.lit("study of no "), i.cast("string"), F.lit("!"))).when(i % 3 == 0, "other").alias("title"))
    return merge.link_published(items, papers).select("item_id", "matched_paper_id", "matched_by")


# --- functions ------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(strip_accents(text) || 'EncaouY') AS bare FROM documents WHERE text IS NOT NULL""")
def h1d_strip_diacritics(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, and letters that they may lack behind them."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(identifiers.strip_diacritics(F.concat("text", F.lit("Éñçäôů" + "Ÿ"))), 256).alias("bare"))


@query(f"""WITH {PAPERS_SQL}, t AS (SELECT id, discovery_date, {_TITLE % "title"} AS t FROM p), k AS (SELECT *, CASE WHEN id % 4 = 1 THEN substr(discovery_date, 1, 4) ELSE '' END AS y FROM t)
SELECT id, CASE WHEN id % 4 = 0 THEN 'doi:10.1234/' || id WHEN id % 4 < 3 AND t <> '' THEN CASE WHEN id % 4 = 1 THEN 'ti:1234-567X:' || substr(t, 1, 120) || ':' || y ELSE 'tt:' || substr(t, 1, 160) || ':' || y END ELSE 'raw:' || sha256('r' || id) END AS key,
  CASE WHEN id % 4 = 0 THEN 'doi:10.1234/' || id WHEN id % 4 < 3 AND t <> '' THEN 'ft:' || substr(t, 1, 140) || ':' || y ELSE 'fs:src:' || id END AS stream, CASE WHEN id % 4 = 0 THEN 'doi:10.1234/' || id WHEN id % 4 = 1 THEN 'acid:P19-' || id ELSE 'aclbib:k' || id END AS bulk FROM k""")
def h1f_dedup_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys from whole first lines as titles."""
    i = F.col("id")
    n = i.cast("string")
    doi, issn = F.when(i % 4 == 0, F.concat(F.lit("10.1234/"), n)), F.when(i % 4 == 1, "1234567X")
    title = F.when(i % 4 < 3, F.col("title"))
    year = F.when(i % 4 == 1, F.substring("discovery_date", 1, 4))
    return views.papers(spark, sf).select("id", identifiers.dedup_key(doi, issn, title, year, F.concat(F.lit("r"), n)).alias("key"), identifiers.stream_key(doi, title, year, F.lit("src"), n).alias("stream"), identifiers.bulk_key(doi, F.when(i % 4 == 1, F.concat(F.lit("P19-"), n)), F.concat(F.lit("k"), n)).alias("bulk"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(replace(html, '<p>', '<p>&#233;&#x4e2d;&ndash; &amp;lt; '), '<[^>]+>', '', 'g') AS t FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&#x4e2d;', '中'), '&#233;', 'é'), '&ndash;', '–'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \t\n\r\f\x0b\x{a0}]+', ' ', 'g'))) AS title FROM h""")
def h1i_decode_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages, each paragraph of which begins with numeric and named entities."""
    raw = F.replace(F.col("html"), F.lit("<p>"), F.lit("<p>&#233;&#x4e2d;&ndash; &amp;lt; "))
    return table(spark, sf, "pages").select("page_id", F.sha2(identifiers.clean_title(raw), 256).alias("title"))


@query(r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \t\n\r\f\x0b\x{a0}]+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split_regex(flat, '(?i)\s+and\s+'), lambda x: trim(x)), lambda x: x <> ''), '|')) AS split,
  sha256(array_to_string(list_filter(list_transform(string_split(replace(text, '.', '[1, 2];'), ';'), lambda x: regexp_replace(replace(x, '[1, 2]', ''), '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g')), lambda x: x <> ''), '|')) AS cleaned FROM t""")
def h1k_author_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as lists of authors: parted by `and`, and by marks of institutions where sentences end."""
    d = table(spark, sf, "documents").where("text is not null")
    cleaned = identifiers.clean_authors(F.replace(F.col("text"), F.lit("."), F.lit("[1, 2];")))
    return d.select("doc_id", F.sha2(F.array_join(identifiers.split_authors(F.col("text")), "|"), 256).alias("split"), F.sha2(F.array_join(cleaned, "|"), 256).alias("cleaned"))


@query("""SELECT c_custkey, 'Ann Lee|Bo|' || c_name AS formatted, 'Ann|' || c_name AS cleaned, 'Lee, Ann|' || c_name AS split FROM customer""")
def h1k_authors(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("c_name")
    none = F.lit(None).cast("string")
    one = lambda n, g, f, l: F.struct(n.alias("name"), g.alias("given"), f.alias("family"), l.alias("literal"))  # noqa: E731, E741
    people = F.array(one(none, F.lit("Ann"), F.lit("Lee"), none), one(F.lit(" "), none, none, F.lit("Bo")), one(none, none, none, none), one(name, none, none, none))
    cleaned = identifiers.clean_authors(F.concat(F.lit("Ann[1,2]； "), name, F.lit(" [3];")))
    split = identifiers.split_authors(F.concat(F.lit("Lee,  Ann\n AND "), name))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(identifiers.format_authors(people), "|").alias("formatted"), F.array_join(cleaned, "|").alias("cleaned"), F.array_join(split, "|").alias("split"))


@query("""SELECT c_custkey, lpad(CAST(1000 + c_custkey % 9000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS arxiv, '10.1234/a b' || c_custkey AS doi, CASE WHEN c_custkey % 2 = 0 THEN 'P19-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE '2021.emnlp-main.' || c_custkey END AS anthology FROM customer""".replace("a b", "a"))
def h1m_ids_from_urls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    n = k.cast("string")
    arxiv = identifiers.base_arxiv_id(F.concat(F.lit("http://arXiv.org/abs/"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0"), F.lit("."), F.lpad(n, 5, "0"), F.lit("v12")))
    doi = identifiers.doi_from_url(F.concat(F.lit("https://x.org/?u=https%3A%2F%2Fdoi.org%2F10.1234%2Fa"), n, F.lit("?x=1")))
    url = F.when(k % 2 == 0, F.concat(F.lit("https://aclanthology.org/P19-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(".pdf"))).otherwise(F.concat(F.lit("https://aclanthology.org/2021.emnlp-main."), n, F.lit("/")))
    return table(spark, sf, "customer").select("c_custkey", arxiv.alias("arxiv"), doi.alias("doi"), identifiers.anthology_id(url).alias("anthology"))


@query("""SELECT p_partkey, 'Q' || (p_size % 4 + 1) AS quartile, CASE WHEN p_size % 2 = 0 THEN 1990 + p_size ELSE 1990 END AS year FROM part""")
def h1o_quartile_year(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("p_size") % 4 + 1).cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("jcr q"), n)).when(F.col("p_size") % 3 == 1, F.concat(F.translate(n, "1234", "一二三四"), F.lit("区"))).otherwise(F.concat(F.lit(" "), n, F.lit("区 ")))
    years = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1990-"), (F.col("p_size") + 1990).cast("string"))).otherwise("ed. 1990")
    return table(spark, sf, "part").select("p_partkey", identifiers.norm_quartile(raw).alias("quartile"), identifiers.year_of(years).cast("long").alias("year"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 2020 ELSE 1990 + p_size % 9 END AS year, CASE p_size % 4 WHEN 0 THEN '03' WHEN 1 THEN '12' WHEN 2 THEN '07' END AS month, CASE WHEN p_size % 3 = 0 THEN '2020' ELSE CAST(1990 + p_size % 9 AS VARCHAR) END || CASE p_size % 4 WHEN 0 THEN '-03' WHEN 1 THEN '-12' WHEN 2 THEN '-07' ELSE '' END AS published,
  CASE WHEN p_size % 5 <> 0 THEN '2024年第' || (p_size % 9 + 1) || '期' END AS issue, CASE WHEN p_size % 5 <> 0 THEN '2024-03-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS day FROM part""")
def h1p_issue_dates(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    year = identifiers.norm_year(F.when(size % 3 != 0, F.concat(F.lit("c. "), (size % 9 + 1990).cast("string"))), F.when(size % 3 == 0, "2020.acl-main.1"))
    month = identifiers.norm_month(F.element_at(F.array(F.lit("Mar."), F.lit("12"), F.lit("july"), F.lit("17-20 ")), (size % 4 + 1).cast("int")))
    page = F.when(size % 5 != 0, F.concat(F.lit("<p>2024年 第"), (size % 9 + 1).cast("string"), F.lit("期 上线 2024年3月"), (size % 28 + 1).cast("string"), F.lit("日</p>"))).otherwise("<p></p>")
    return table(spark, sf, "part").select("p_partkey", year.cast("long").alias("year"), month.alias("month"), identifiers.published_date_of(year, month).alias("published"), identifiers.parse_issue(page)["label"].alias("issue"), identifiers.parse_catalog_date(page).alias("day"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a|' || p_brand ELSE 'a' END AS keywords FROM part""")
def h1r_keyword_list(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda n, d: F.struct(n.cast("string").alias("name"), d.cast("string").alias("display_name"))
    items = F.array(one(F.lit(" a "), F.lit("x")), one(F.lit(""), F.lit(" ")), one(F.lit(None), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(identifiers.keyword_list(items), "|").alias("keywords"))


@query("""SELECT c_custkey, 'key *** and Bearer *** for ' || c_name AS message FROM customer""")
def h1t_redact(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("key s3cret-9 and bearer abc.DEF-1 for "), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", identifiers.redact(raw, ["s3cret-9"]).alias("message"))


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE 1 END AS n, least(length(text), 2000) AS chars FROM documents WHERE trim(text) <> ''""")
def h1v_prune_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.create_map(F.lit("abstract"), F.lit("gone"), F.lit("note"), F.col("text"), F.lit("blank"), F.lit("  "))
    rows = table(spark, sf, "documents").where("trim(text) <> ''").select("doc_id", identifiers.prune_fields(fields).alias("f"))
    return rows.select("doc_id", F.size("f").alias("n"), F.length(F.element_at("f", F.lit("note"))).cast("long").alias("chars"))


@query(f"""WITH {PAPERS_SQL}, d AS (SELECT id, CASE WHEN id % 2 = 0 THEN discovery_date END AS o, CASE WHEN id % 3 = 0 THEN substr(discovery_date, 1, 7) END AS pr, CASE WHEN id % 5 = 0 THEN substr(discovery_date, 1, 4) END AS i FROM p),
k AS (SELECT *, CASE WHEN o IS NOT NULL AND o NOT LIKE '%-01-01' THEN 'online' WHEN pr IS NOT NULL THEN 'print' WHEN o IS NOT NULL THEN 'online' WHEN i IS NOT NULL THEN 'issued' END AS kind FROM d) SELECT id, kind, CASE kind WHEN 'online' THEN o WHEN 'print' THEN pr ELSE i END AS value FROM k""")
def h3c_best_date(spark: SparkSession, sf: str) -> DataFrame:
    i, day = F.col("id"), F.col("discovery_date")
    best = dates.best_pub_date(F.when(i % 2 == 0, day), F.when(i % 3 == 0, F.substring(day, 1, 7)), F.when(i % 5 == 0, F.substring(day, 1, 4)))
    return views.papers(spark, sf).select("id", best.alias("b")).select("id", "b.kind", "b.value")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""")
def h3d_date_from_parts(spark: SparkSession, sf: str) -> DataFrame:
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate")
    parts = F.when(F.col("o_orderkey") % 4 == 0, F.array(y)).when(F.col("o_orderkey") % 4 == 1, F.array(y, m, F.lit(32))).when(F.col("o_orderkey") % 4 == 2, F.array(y, F.lit(13), d)).otherwise(F.array(y, m, d))
    return table(spark, sf, "orders").select("o_orderkey", dates.date_from_parts(parts).alias("date"))


@query("""SELECT event_id, strftime(ts - CASE WHEN event_id % 3 = 2 THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, event_id % 3 = 0 AS naive FROM events""")
def h3e_instants(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, text).when(F.col("event_id") % 3 == 1, F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise(F.concat(text, F.lit("+08:00")))
    return e.select("event_id", dates.to_iso_utc(raw).alias("iso"), dates.is_naive(raw).alias("naive"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM events""".replace(" AS at", ' AS "at"'))
def h3g_stored_times(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, text).otherwise(F.concat(F.substring(iso, 1, 19), F.lit(".000Z"))).alias("at"))
    return audit.stored_times(rows, "at")[0]


@query("""SELECT count(*) FILTER (WHERE event_id % 2 = 0) AS changed_at FROM events""")
def h3g_changed_times(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, text).otherwise(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))).alias("at"))
    return audit.stored_times(rows, "at")[1]


@query("""WITH l AS (SELECT event_id, ts + INTERVAL 8 HOUR AS t FROM events), d AS (SELECT event_id, t, date_trunc('day', t) + INTERVAL '7 hours 30 minutes' AS d FROM l)
SELECT event_id, strftime(CASE WHEN d > t THEN d ELSE d + INTERVAL 1 DAY END - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS next FROM d""")
def h3h_next_run(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format(dates.next_run_at(F.col("ts"), 7, 30), "yyyy-MM-dd HH:mm").alias("next"))


@query(f"""WITH {PAPERS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'manual' WHEN id % 2 = 0 THEN 'new' ELSE language END AS language FROM p""")
def i3_sticky_language(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    old = F.when(i % 3 == 0, "manual").otherwise(F.col("language"))
    return views.papers(spark, sf).select("id", merge.sticky_language(old, F.when(i % 3 == 0, "manual").otherwise("auto"), F.when(i % 2 == 0, "new")).alias("language"))


@query(f"""WITH {PAPERS_SQL} SELECT id, CASE WHEN id % 3 <> 0 THEN discovery_date ELSE '2001-08-02' END AS discovery_date, CASE WHEN id % 3 <> 1 THEN 'T' || id ELSE title END AS title, CASE WHEN id % 3 = 1 THEN 'a' WHEN id % 3 = 0 THEN 'b' ELSE 'a,b' END AS sources FROM p""")
def i4_paper_policy(spark: SparkSession, sf: str) -> DataFrame:
    p = views.papers(spark, sf)
    base = p.where("id % 3 <> 0").select("id", "title", "discovery_date", F.array(F.lit("a")).alias("sources"))
    batch = p.where("id % 3 <> 1").select("id", F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.lit("2001-08-02").alias("discovery_date"), F.array(F.lit("b")).alias("sources"))
    return merge.upsert(base, batch, "id", merge.policy_for(base, merge.PAPER_POLICY)).select("id", "discovery_date", "title", F.array_join("sources", ",").alias("sources"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber * 100000000 + l_partkey * 1000 + CAST(l_quantity AS INTEGER) AS o, l_linenumber % 3 AS m, repeat('x', CAST(l_quantity AS INTEGER)) AS abstract FROM lineitem),
f AS (SELECT *, first_value(o) OVER (PARTITION BY k, m ORDER BY o) AS f FROM r)
SELECT k, max(abstract) AS abstract, 's' || arg_max(o, struct_pack(a := length(abstract), b := -o)) AS abstract_source, array_to_string(list_sort(list_distinct(list('k' || m || '=' || f))), ',') AS ids FROM f GROUP BY 1""")
def i1_merge_policy(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    o = line * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_quantity").cast("int")
    ids = F.create_map(F.concat(F.lit("k"), (line % 3).cast("string")), o.cast("string"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), o.alias("o"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("abstract"), F.concat(F.lit("s"), o.cast("string")).alias("abstract_source"), ids.alias("external_ids"))
    merged = merge.merge_records(rows, "k", "o", merge.policy_for(rows, merge.MERGE_POLICY))
    return merged.select("k", "abstract", "abstract_source", F.array_join(F.array_sort(F.transform(F.map_entries("external_ids"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("ids"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type AS source, event_type <> 'error' AS ok FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, source, count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS n_failed FROM d GROUP BY 1, 2""")
def i14_rolling_health(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.streaming.upserts import rolling_health

    return rolling_health(views.log(spark, sf)).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "source", "requests", "n_failed")


@query("""SELECT '10.1234/' || p_partkey AS doi, CASE WHEN p_partkey % 4 = 0 THEN 'first ' || p_brand ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'second' END AS abstract FROM part""")
def i16_add_by_doi(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    doi = F.concat(F.lit("10.1234/"), F.col("p_partkey").cast("string"))
    wanted = p.where("p_partkey % 4 = 0")
    base = p.select(doi.alias("doi"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("abstract"))
    first = wanted.select(F.concat(F.lit("https://doi.org/"), doi).alias("doi"), F.concat(F.lit("first "), "p_brand").alias("title"), F.lit(None).cast("string").alias("abstract"))
    second = wanted.select(doi.alias("doi"), F.lit("x").alias("title"), F.lit("second").alias("abstract"))
    return merge.add_by_doi(base, first, second, wanted.select(doi.alias("doi"))).select("doi", "title", "abstract")


@query(f"""WITH {LOG_SQL} SELECT source, max("at") AS last_check, max(CASE WHEN ok THEN "at" END) AS last_ok, arg_max(status, "at") AS last_status, CAST(sum(added) AS BIGINT) AS added, min("at") AS first_seen,
  coalesce(max(CASE WHEN ok THEN "at" END) > max(CASE WHEN NOT ok THEN "at" END), false) AS recovered FROM g GROUP BY 1""")
def d21_stream_states(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream in three micro-batches, each with rows of all times, and the states that it ends with."""
    log = views.log(spark, sf).select("id", "at", "source", "ok", "status", "added")
    at = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    stream = states.replay(spark, log, f"{at}/log", 3)
    states.keep_states(stream, f"{at}/table", f"{at}/checkpoint", silent_after=7 * 86_400_000, late="400 days").awaitTermination()
    return keyed_table(spark, f"{at}/table", f"source string, {states.STATES}").select("source", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_check", "last_ok", "first_seen")), "last_status", "added", "recovered")
