"""Queries of topic evidence and scores, over papers whose texts begin with a phrase of a study, Chinese ones among them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, domain, evidence, topics
from lectern.functions.language import let
from lectern.operators import memo
from lectern.operators import terms as term_joins
from lectern.operators.annotate import Settings, annotate
from lectern.plans import views
from lectern.plans import queries
from lectern.plans.queries import _NORMAL, ORACLES, query
from lectern.plans.views import PAPERS_SQL, TODAY
from lectern.session import shared_dir

PHRASES = (
    "Second language learners in a classroom study", "L2 regularization of a large language model", "Patients with dementia: diagnosis and treatment by a chatbot",
    "国际中文教育中的汉语教学与中介语习得研究", "Grammar and vocabulary development of students", "Translation accuracy and foreign-language anxiety; l2 learners",
    "Mandarin-speaking learners and English pronunciation", "患者临床护理与健康的调查", "Learning analytics in STEM education courses", "Uptake of pharmacy drugs",
    "Chatbot for automated writing evaluation, with a language model", "汉字与拼音",
)
TITLES = ("Teaching with chatbots", "A note", "Clinical rubric", "教学研究", "University courses")


def _literals(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STUDIES_SQL = f"""{PAPERS_SQL}, s AS (SELECT id, {_literals(TITLES)}[id % {len(TITLES)} + 1] AS title, {_literals(PHRASES)}[id % {len(PHRASES)} + 1] || '. ' || abstract AS text, discovery_date, citation_count, language FROM p)"""


def studies(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))
    return views.papers(spark, sf).select("id", pick(TITLES).alias("title"), F.concat(pick(PHRASES), F.lit(". "), "abstract").alias("text"), "discovery_date", "citation_count", "language")


def _held(value: Column) -> Column:
    """A value behind a barrier, so that it is made once a row."""
    return F.explode(F.array(value))


def _neutral_sql(text: str) -> str:
    out = f"lower({text})"
    for n in domain.NEUTRAL:
        out = f"replace({out}, '{n}', '{domain.NEUTRAL_MARK}')"
    return out


def _count_sql(text: str, terms) -> str:
    return f"len(list_filter({_literals(terms)}, lambda x: contains({text}, x)))"


_DOMAIN_SQL = f"""CASE WHEN {_count_sql("t", domain.LANGUAGE_STRONG)} > 0 THEN 'edu' WHEN {_count_sql("t", domain.LANGUAGE_SUBJECT)} > 0 AND {_count_sql("t", domain.ACADEMIC_CONTEXT)} > 0 THEN 'subject+context'
  WHEN {_count_sql("t", domain.LANGUAGE_WEAK)} > 0 AND {_count_sql("t", domain.LANGUAGE_ANCHOR)} > 0 THEN 'weak+anchor' ELSE 'none' END"""
_EDU_SQL = f"len(list_distinct(list_concat(list_filter({_literals(domain.EDUCATION_TITLE)}, lambda x: contains(nt, x)), list_filter({_literals(domain.EDUCATION_OBJECT)}, lambda x: contains(t, x)))))"
_OTHER_SQL = _count_sql("t", domain.OTHER_OBJECT)


@query(f"""WITH {STUDIES_SQL}, n AS (SELECT id, {_neutral_sql("text")} AS t FROM s), d AS (SELECT id, {_DOMAIN_SQL} AS tier FROM n) SELECT id, tier, tier <> 'none' AS in_domain FROM d""")
def h4d_language_domain(spark: SparkSession, sf: str) -> DataFrame:
    return studies(spark, sf).select("id", domain.language_domain(F.col("text")).alias("d")).select("id", "d.tier", "d.in_domain")


@query(f"""WITH {STUDIES_SQL}, n AS (SELECT id, {_neutral_sql("text")} AS t, {_neutral_sql("title")} AS nt FROM s), c AS (SELECT id, {_EDU_SQL} AS e, {_OTHER_SQL} AS o FROM n)
SELECT id, CAST(e AS INTEGER) AS education, CAST(o AS INTEGER) AS other, e > 0 AS is_education, o >= 1 AND o >= e AS not_education FROM c""")
def h4e_research_object(spark: SparkSession, sf: str) -> DataFrame:
    return studies(spark, sf).select("id", domain.research_object(F.col("text"), F.col("title")).alias("o")).select("id", "o.*")


@query(f"""WITH {STUDIES_SQL} SELECT id, {_count_sql("lower(text)", domain.CHINESE_FOCUS)} > 0 AS focus FROM s""")
def h4f_chinese_focus(spark: SparkSession, sf: str) -> DataFrame:
    return studies(spark, sf).select("id", domain.has_chinese_focus(F.col("text")).alias("focus"))


AI, PEDAGOGY, CHINESE = ("人工智能", "large language model", "chatbot", "automated"), ("教学", "课堂", "learner", "course", "classroom"), ("汉语", "中文", "汉字", "mandarin")


@query(f"""WITH {STUDIES_SQL} SELECT id, CAST(round(least(1.0, 0.35 * {_count_sql("lower(text)", AI)} + 0.25 * {_count_sql("lower(text)", PEDAGOGY)} + 0.3 * {_count_sql("lower(text)", CHINESE)}), 4) AS DOUBLE) AS value FROM s""")
def h4i_research_value(spark: SparkSession, sf: str) -> DataFrame:
    return studies(spark, sf).select("id", F.round(domain.research_value(F.col("text"), AI, PEDAGOGY, CHINESE), 4).alias("value"))


@query(f"""WITH {STUDIES_SQL}, t AS (SELECT id, CASE WHEN id % 10 = 0 THEN text || ' 教学 mandarin' ELSE text END AS text FROM s)
SELECT id, CAST(round(least(1.0, 0.35 * {_count_sql("lower(text)", AI)} + 0.25 * {_count_sql("lower(text)", PEDAGOGY)} + 0.3 * {_count_sql("lower(text)", CHINESE)}), 4) AS DOUBLE) AS value,
  (SELECT count(*) FROM t) AS cold, 0 AS warm, (SELECT count(*) FROM t WHERE id % 10 = 0) AS edited, (SELECT count(*) FROM t) AS other_day FROM t""")
def i8_memo_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A first run, one over the same rows, one after edits, one in another context: values of the third, and what each computed."""
    rows, path = studies(spark, sf).select("id", "text"), f"{shared_dir(spark)}/memo-{uuid.uuid4().hex}"
    edited = rows.withColumn("text", F.when(F.col("id") % 10 == 0, F.concat("text", F.lit(" 教学 mandarin"))).otherwise(F.col("text")))
    score = lambda df: df.withColumn("value", F.round(domain.research_value(F.col("text"), AI, PEDAGOGY, CHINESE), 4))
    runs = [memo.memoise(r, "id", day, score, path, ("value",), parts=8) for r, day in ((rows, TODAY), (rows, TODAY), (edited, TODAY), (edited, "2001-08-03"))]
    counts = zip(("cold", "warm", "edited", "other_day"), (r.computed for r in runs), strict=True)
    return runs[2].rows.select("id", "value", *(F.lit(n).cast("long").alias(name) for name, n in counts))


#: Topics in the way of a reader's settings: keywords in two languages, markers, gates.
TOPICS = [
    topics.Topic("sla", ("second language acquisition", "interlanguage", "中介语习得研究"), ("l2", "second language", "中介语", "uptake", "foreign language")),
    topics.Topic("edtech", ("artificial intelligence education", "learning analytics", "automated writing evaluation"), ("chatbot", "learning analytics", "large language model", "language model"), gated=True),
    topics.Topic("chinese", ("国际中文教育", "chinese language teaching", "汉语教学研究"), ("mandarin", "汉语", "拼音", "国际中文教育"), focused=True, loose=frozenset(("mandarin", "拼音"))),
    topics.Topic("wordlists", ("vocabulary development", "anxiety"), excluded=("patients",)),
]


def _has_sql(term: str) -> str:
    return f"contains(m, '{topics._needle(term)}')" if term.isascii() else f"contains(lower(text), '{term.lower()}')"


def _terms_sql(terms) -> str:
    return "(" + (" + ".join(f"CAST({_has_sql(t)} AS INTEGER)" for t in terms) or "0") + ")"


def _hit_sql(topic: topics.Topic) -> tuple[str, str, str]:
    """Score, number of markers and whether it is off the field, in SQL over m, text, tier, e, o, focus."""
    ratios = []
    for keyword in topic.keywords:
        telling = [w for w in topics.tokenize(keyword) if w not in topic.generic and len(w) > 3]
        if telling:
            n, k = _terms_sql(telling), len(telling)
            ratios.append(f"CASE WHEN {_has_sql(keyword)} OR ({n} >= 2 AND {k} > 1) THEN {n} / CAST({k} AS DOUBLE) ELSE 0.0 END")
    flags = topics.markers_of(topic)
    spec, size = _terms_sql(flags), max(1, len(ratios))
    unclear, loose = _terms_sql([f for f in flags if f in topics.AMBIGUOUS]), _terms_sql([f for f in flags if f in topic.loose])
    no = f"({_terms_sql(topic.excluded)} > 0) OR ({unclear} = {spec} AND tier = 'none')"
    off = "false"
    if topic.gated:
        off = "NOT (NOT (o >= 1 AND o >= e) AND (tier <> 'none' OR e > 0))"
    if topic.focused:
        off = f"({off}) OR (NOT focus AND {loose} = {spec})"
    total, coverage = " + ".join(ratios), " + ".join(f"CASE WHEN {r} > 0 THEN 1 ELSE 0 END" for r in ratios)
    score = f"round(least(1.0, 1.8 * (({total}) / {size}) + 0.25 * (({coverage}) / CAST({size} AS DOUBLE)) + CASE WHEN {spec} = 1 THEN 0.14 ELSE least({spec} * 0.18, 0.6) END), 3)"
    hit = f"({spec} > 0 AND NOT ({no}))"
    return f"CAST(CASE WHEN {hit} AND NOT ({off}) THEN {score} ELSE 0.0 END AS DOUBLE)", f"CAST({spec} AS INTEGER)", f"({hit} AND ({off}))"


def _named(i: int, what: str) -> str:
    return f"{TOPICS[i].slug}_{what}"


_HITS_SQL = f"""{STUDIES_SQL}, n AS (SELECT id, text, title, {_NORMAL.replace("title || ' ' || abstract", "text")} AS m, {_neutral_sql("text")} AS t, {_neutral_sql("title")} AS nt FROM s),
g AS (SELECT id, text, m, {_DOMAIN_SQL} AS tier, {_EDU_SQL} AS e, {_OTHER_SQL} AS o, {_count_sql("lower(text)", domain.CHINESE_FOCUS)} > 0 AS focus FROM n),
h AS (SELECT id, {", ".join(f"{sql} AS {_named(i, what)}" for i, t in enumerate(TOPICS) for sql, what in zip(_hit_sql(t), ("score", "markers", "cross")))} FROM g)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    held = studies(spark, sf).select("id", _held(F.struct(topics.matchable(F.col("text")).alias("m"), topics.about_of(F.col("text"), F.col("title")).alias("about"))).alias("v"))
    return held.select("id", topics.topic_hits(F.col("v.m"), TOPICS, F.col("v.about")).alias("hits"))


@query(f"WITH {_HITS_SQL} SELECT * FROM h")
def h4c_topic_hits(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda t: let(F.element_at("hits", F.lit(t.slug)), lambda x: x)
    return _hits(spark, sf).select("id", *(one(t)[what].alias(f"{t.slug}_{what}") for t in TOPICS for what in ("score", "markers", "cross")))


@query(f"WITH {_HITS_SQL} SELECT id, NOT ({' OR '.join(f'{t.slug}_score > 0' for t in TOPICS)}) AND ({' OR '.join(f'{t.slug}_cross' for t in TOPICS)}) AS cross_domain FROM h")
def h4g_cross_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("id", topics.is_cross_domain(F.col("hits")).alias("cross_domain"))


@query(f"WITH {_HITS_SQL} {' UNION ALL '.join(f"SELECT id, '{t.slug}' AS slug, {t.slug}_score AS score, {t.slug}_markers AS markers, {t.slug}_cross AS cross FROM h WHERE {t.slug}_markers > 0" for t in TOPICS)}")
def h4c_topics_joined(spark: SparkSession, sf: str) -> DataFrame:
    rows = studies(spark, sf).select("id", "text", topics.about_of(F.col("text"), F.col("title")).alias("about"))
    return term_joins.join_topics(rows, "id", "text", term_joins.topic_table(spark, TOPICS), "about")


#: A term list as long as the tables: how each document begins, in two, three and five words.
@query(r"""WITH n AS (SELECT doc_id AS id, ' ' || regexp_replace(regexp_replace(lower(text), '[^a-z0-9 \t\n\x0b\f\r\-]', ' ' || chr(1) || ' ', 'g'), '[ \t\n\x0b\f\r\-]+', ' ', 'g') || ' ' AS m, string_split_regex(trim(text), '[ \n]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT DISTINCT ' ' || trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9 \t\n\x0b\f\r\-]', ' ' || chr(1) || ' ', 'g'), '[ \t\n\x0b\f\r\-]+', ' ', 'g')) || ' ' AS t FROM (SELECT unnest([array_to_string(w[1:k], ' ') FOR k IN [2, 3, 5]]) AS x FROM n) AS a WHERE x <> '' AND length(x) = strlen(x))
SELECT id, count(*) AS n, min(trim(t)) AS first FROM n JOIN t ON contains(m, t) WHERE trim(t) <> '' GROUP BY 1""")
def c14_term_match(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").where("text is not null")
    words = F.split(F.trim("text"), "[ \n]+", 6)  # the sixth is the rest
    begins = d.select(F.explode(F.array(*(F.array_join(F.slice(words, 1, k), " ") for k in (2, 3, 5)))).alias("term")).where(F.char_length("term") == F.octet_length("term"))
    found = term_joins.match_lists(d, "doc_id", "text", begins)
    first = F.array_min(F.transform("needles", lambda x: F.trim(x)))
    of_one = found.select(F.col("doc_id").alias("id"), F.size("needles").cast("long").alias("n"), first.alias("first"))
    return of_one.groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


# the scores of the list's own topics, without gates
_SCORES_SQL = ", ".join(f'{_hit_sql(t)[0]} AS "{t.slug.replace("-", "_")}"' for t in queries.TOPICS)
_TOP_SQL = ", ".join(f"""CASE WHEN "{t.slug.replace("-", "_")}" >= 0.35 THEN struct_pack(s := -"{t.slug.replace("-", "_")}", k := '{t.slug}') END""" for t in queries.TOPICS)
ORACLES["h4c_topic_scores"] = f"""WITH {PAPERS_SQL}, n AS (SELECT id, title || ' ' || abstract AS text, {_NORMAL} AS m, 'edu' AS tier, 0 AS e, 0 AS o, true AS focus FROM p), h AS (SELECT id, {_SCORES_SQL} FROM n)
SELECT *, coalesce(array_to_string(list_transform(list_slice(list_sort(list_filter([{_TOP_SQL}], lambda x: x IS NOT NULL)), 1, 3), lambda x: x.k), ','), '') AS top FROM h"""

_INFERRED_SQL = ", ".join(f"CASE WHEN {t.slug}_score >= 0.35 AND {t.slug}_markers >= 1 AND NOT {t.slug}_cross THEN struct_pack(s := -{t.slug}_score, k := '{t.slug}') END" for t in TOPICS)


@query(f"WITH {_HITS_SQL} SELECT id, coalesce(array_to_string(list_transform(list_slice(list_sort(list_filter([{_INFERRED_SQL}], lambda x: x IS NOT NULL)), 1, 3), lambda x: x.k), ','), '') AS topics FROM h")
def f5_infer_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("id", F.array_join(topics.infer_topics(F.col("hits")), ",").alias("topics"))


CATEGORIES = {"acquisition": ("sla", "wordlists"), "technology": ("edtech",), "chinese": ("chinese",)}


@query(f"""WITH {_HITS_SQL} SELECT id, concat_ws(',', {", ".join("CASE WHEN " + " OR ".join(f"{s}_score > 0" for s in slugs) + f" THEN '{c}' END" for c, slugs in CATEGORIES.items())}) AS categories FROM h""")
def h4m_category_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("id", F.array_join(topics.category_ids(topics.scores_of(F.col("hits")), CATEGORIES), ",").alias("categories"))


TERMS = ("second language", "l2", "foreign language", "汉语教学", "中介语", "chatbot", "language model", "a note")


@query(f"""WITH {STUDIES_SQL}, n AS (SELECT id, text, {_NORMAL.replace("title || ' ' || abstract", "text")} AS m FROM s) SELECT id, CAST({_terms_sql(TERMS)} AS INTEGER) AS n, {_has_sql("汉语")} AS zh FROM n""")
def h4a_terms_of_two_scripts(spark: SparkSession, sf: str) -> DataFrame:
    held = studies(spark, sf).select("id", _held(topics.matchable(F.col("text"))).alias("m"))
    return held.select("id", topics.count_terms(F.col("m"), TERMS).alias("n"), topics.has_term(F.col("m"), "汉语").alias("zh"))


DIRECTIONS = [
    topics.Direction("ai-teaching", ("chatbot", "large language model", "second language", "language teaching"), ("chatbot", "large language model")),
    topics.Direction("assessment", ("automated writing evaluation", "writing evaluation", "language model"), ("automated writing evaluation",)),
    topics.Direction("analytics", ("learning analytics", "education"), ("learning analytics",)),
]


def _direction_sql(d: topics.Direction) -> str:
    return f"CASE WHEN {_terms_sql(d.terms)} >= 2 AND {_terms_sql(d.anchors)} >= 1 THEN '{d.slug}' END"


_DIRECTIONS_SQL = f"""{STUDIES_SQL}, n AS (SELECT id, text, discovery_date, {_NORMAL.replace("title || ' ' || abstract", "text")} AS m FROM s), f AS (SELECT id, discovery_date, list_filter([{", ".join(map(_direction_sql, DIRECTIONS))}], lambda x: x IS NOT NULL) AS d FROM n)"""


@query(f"WITH {_DIRECTIONS_SQL} SELECT id, array_to_string(d, ',') AS directions FROM f")
def h4n_hit_directions(spark: SparkSession, sf: str) -> DataFrame:
    held = studies(spark, sf).select("id", _held(topics.matchable(F.col("text"))).alias("m"))
    return held.select("id", F.array_join(topics.hit_directions(F.col("m"), DIRECTIONS), ",").alias("directions"))


_FRONTIER_SQL = f"""{_DIRECTIONS_SQL}, r AS (SELECT id, d, discovery_date, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(discovery_date, 1, 4) ELSE discovery_date END AS day FROM f),
a AS (SELECT *, CASE WHEN day IS NOT NULL THEN greatest(0, date_diff('day', CAST(CASE WHEN length(day) = 4 THEN day || '-07-01' ELSE day END AS DATE), DATE '{TODAY}')) END AS age, length(day) = 10 AND NOT day LIKE '%-01-01' AS exact FROM r),
v AS (SELECT id, discovery_date, len(d) AS n_directions, CAST(round(len(d) + 0.5 + 0.6 * CASE WHEN age IS NULL THEN 0.3 ELSE (CASE WHEN age <= 30 THEN 1.0 WHEN age <= 90 THEN 0.8 WHEN age <= 365 THEN 0.5 ELSE 0.25 END) * CASE WHEN exact THEN 1.0 ELSE 0.6 END END + CASE WHEN id % 3 = 0 THEN 0.15 ELSE 0.0 END, 4) AS DOUBLE) AS score FROM a)"""


def _frontier(spark: SparkSession, sf: str, newest: int | None = None) -> DataFrame:
    """Scores of all studies, or of the newest ones alone: these are chosen before a text is looked at."""
    rows = studies(spark, sf)
    if newest:
        last = rows.select("id", "discovery_date").orderBy(F.col("discovery_date").desc(), "id").limit(newest)
        rows = rows.join(F.broadcast(last.select("id")), "id", "left_semi")
    held = rows.select("id", "discovery_date", "language", _held(topics.matchable(F.col("text"))).alias("m"))
    day = F.when(F.col("id") % 4 == 1, F.substring("discovery_date", 1, 4)).when(F.col("id") % 4 > 1, F.col("discovery_date"))
    found = held.select("id", "discovery_date", "language", day.alias("day"), topics.hit_directions(F.col("m"), DIRECTIONS).alias("d"))
    return found.select("id", "discovery_date", "language", F.size("d").cast("long").alias("n_directions"), topics.frontier_score(F.col("d"), F.lit("some"), F.col("day"), F.col("id") % 3 == 0, TODAY).alias("score"))


@query(f"WITH {_FRONTIER_SQL} SELECT id, n_directions, score FROM v")
def h4o_frontier_score(spark: SparkSession, sf: str) -> DataFrame:
    return _frontier(spark, sf).select("id", "n_directions", "score")


DESIGNS = {"survey": ("调查", "survey"), "experiment": ("pharmacy", "treatment", "regularization")}


@query(f"""WITH {STUDIES_SQL}, l AS (SELECT id, lower(text) AS t FROM s), d AS (SELECT id, {_count_sql("t", DESIGNS["survey"])} > 0 AS a, {_count_sql("t", DESIGNS["experiment"])} > 0 AS b, {_count_sql("t", ("study", "dementia"))} > 0 AS e, {_count_sql("t", ("model", "研究"))} > 0 AS h FROM l)
SELECT id, concat_ws(',', CASE WHEN a THEN 'survey' END, CASE WHEN b THEN 'experiment' END) AS designs, CAST(round(least(1.0, 0.3 * (CAST(a AS INTEGER) + CAST(b AS INTEGER)) + CASE WHEN e THEN 0.4 ELSE 0 END + CASE WHEN h THEN 0.2 ELSE 0 END), 3) AS DOUBLE) AS score FROM d""")
def h4h_method_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = studies(spark, sf).select("id", topics.method_profile(F.col("text"), DESIGNS, ("study", "dementia"), ("model", "研究")).alias("m"))
    return found.select("id", F.array_join("m.designs", ",").alias("designs"), F.round("m.score", 3).alias("score"))


@query(f"""WITH {PAPERS_SQL}, c AS (SELECT id, round(CASE WHEN length(abstract) > 0 THEN 0.5 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN status = 'O' THEN 0.2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END, 3) AS complete, citation_count AS n FROM p)
SELECT id, CAST(complete AS DOUBLE) AS complete, CAST(round(least(1.0, log10(n + 1) / 2), 4) AS DOUBLE) AS cite, CAST(round(0.34 * 0.5 + 0.20 * 0.85 + 0.16 * 0.4 + 0.18 * 0.25 + 0.07 * complete + 0.05 * least(1.0, log10(n + 1) / 2), 4) AS DOUBLE) AS score FROM c""")
def h4k_paper_score(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    complete = topics.completeness(F.col("abstract"), F.when(i % 2 == 0, "10.1/x"), F.col("status") == "O", F.when(i % 3 == 0, "u"))
    rows = views.papers(spark, sf).select("id", complete.alias("complete"), topics.citation_score(F.col("citation_count")).alias("c"))
    return rows.select("id", "complete", F.round("c", 4).alias("cite"), topics.paper_score(F.lit(0.5), F.lit(0.85), F.lit(0.4), F.lit(0.25), F.col("complete"), F.col("c")).alias("score"))


@query(f"""WITH {PAPERS_SQL}, a AS (SELECT id, abstract, discovery_date AS day, date_diff('day', CAST(discovery_date AS DATE), DATE '{TODAY}') AS age FROM p),
f AS (SELECT *, CASE WHEN day LIKE '%-01-01' THEN date_diff('day', CAST(substr(day, 1, 4) || '-07-01' AS DATE), DATE '{TODAY}') ELSE age END AS d, CASE WHEN day LIKE '%-01-01' THEN 0.6 ELSE 1.0 END AS w FROM a)
SELECT id, CAST(round(w * CASE WHEN d <= 3 THEN 1.0 WHEN d <= 10 THEN 0.85 WHEN d <= 30 THEN 0.65 WHEN d <= 60 THEN 0.4 WHEN d <= 120 THEN 0.2 ELSE 0.05 END, 4) AS DOUBLE) AS fresh,
  CAST(round(0.55 * 0.5 + 0.33 * w * CASE WHEN d <= 3 THEN 1.0 WHEN d <= 10 THEN 0.85 WHEN d <= 30 THEN 0.65 WHEN d <= 60 THEN 0.4 WHEN d <= 120 THEN 0.2 ELSE 0.05 END + CASE WHEN length(abstract) > 0 THEN 0.07 ELSE 0 END + CASE WHEN day = '{TODAY}' THEN 0.05 ELSE 0 END, 4) AS DOUBLE) AS score FROM f""")
def h4p_list_score(spark: SparkSession, sf: str) -> DataFrame:
    fresh = dates.freshness_order(F.col("discovery_date"), TODAY)
    rows = views.papers(spark, sf).select("id", "discovery_date", "abstract", fresh.alias("fresh"))
    return rows.select("id", F.round("fresh", 4).alias("fresh"), topics.list_score(F.lit(0.5), F.col("fresh"), F.length("abstract") > 0, F.col("discovery_date") == TODAY).alias("score"))


@query(f"""WITH {PAPERS_SQL} SELECT id, substr(abstract, 1, 300) AS preview, concat_ws(',', CASE WHEN contains(lower(abstract), 'the ') THEN 'the' END) AS designs FROM p""")
def h6l_rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    designs = topics.method_profile(F.col("abstract"), {"the": ("the ",)}, ("x",), ("y",))["designs"]
    return views.papers(spark, sf).select("id", topics.rule_summary(F.col("abstract"), designs, F.array("language")).alias("s")).select("id", "s.preview", F.array_join("s.designs", ",").alias("designs"))


# --- evidence of texts ----------------------------------------------------------------------------------------------

_SENTENCES_SQL = r"""x AS (SELECT doc_id, place, section, trim(regexp_replace(u.x, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS x, i FROM (SELECT doc_id, place, section, regexp_extract_all(text, '[^.!?;]*[.!?;]|[^.!?;]+$') AS xs FROM parts), unnest(xs) WITH ORDINALITY AS u(x, i)),
k AS (SELECT doc_id, place, section, i, CASE WHEN length(x) > 400 THEN list_transform(range(0, CAST(ceil(length(x) / 300) AS BIGINT)), lambda n: substr(x, n * 300 + 1, 300)) ELSE [x] END AS ps FROM x WHERE length(x) > 1),
e AS (SELECT doc_id, section, u.p AS sentence, row_number() OVER w AS n, sum(length(u.p)) OVER w AS c FROM k, unnest(ps) WITH ORDINALITY AS u(p, j) WINDOW w AS (PARTITION BY doc_id ORDER BY place, i, j))"""


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    ids = views.table(spark, sf, "documents").select("doc_id")
    return ids.select("doc_id", F.concat(F.lit("see [S1] and [S"), (F.col("doc_id") % 7 + 2).cast("string"), F.lit("] but not [S90000]")).alias("reply"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents")
    parts = d.select("doc_id", F.lit(0).alias("place"), F.lit("abstract").alias("section"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text")).unionByName(d.select("doc_id", F.lit(1).alias("place"), F.lit("body").alias("section"), "text"))
    return evidence.numbered_sentences(parts)


_PARTS_SQL = "parts AS (SELECT doc_id, 0 AS place, 'abstract' AS section, split_part(text, chr(10), 1) AS text FROM documents UNION ALL SELECT doc_id, 1, 'body', text FROM documents)"


@query(f"WITH {_PARTS_SQL}, {_SENTENCES_SQL} SELECT doc_id, 'S' || n AS sid, section, sentence FROM e WHERE c <= 46000")
def h6c_numbered_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf)


@query(f"WITH {_PARTS_SQL}, {_SENTENCES_SQL} SELECT doc_id, 'S' || n AS sid, sentence, length(sentence) AS chars, n = 1 OR n = doc_id % 7 + 2 AS cited FROM e WHERE c <= 46000")
def h6e_material_rows(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.material_rows(_evidence(spark, sf), _replies(spark, sf)).withColumn("chars", F.col("chars").cast("long"))


@query("""WITH c AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, 'see [S' || m || CASE WHEN m = 0 THEN '], [S0] and [?]' ELSE '], [S0] and [?]' END AS reply FROM c""")
def h6d_replace_bogus(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.concat(F.lit("S"), F.col("turn").cast("string"))).alias("sids"), F.max("turn").cast("string").alias("m"))
    return c.select("conv_id", evidence.replace_bogus(F.concat(F.lit("see [S"), F.col("m"), F.lit("], [S0] and [S99]")), F.col("sids")).alias("reply"))


@query(r"""SELECT doc_id AS paper_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND NOT length(text) < 200 AND NOT (length(text) >= 60 AND 1.0 - length(regexp_replace(text, '[^\p{L}\p{N}\p{P}\s]', '', 'g')) / length(text) > 0.15)""")
def a32_fulltext_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text", F.lit(1).alias("pages"))
    return evidence.fulltext_rows(d, r"^(The|La|Der|Le) [^.]{1,60}$").select("paper_id", F.length("text").cast("long").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'one ' || turn ELSE NULL END AS first FROM conversations""")
def h6k_keyed_replies(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations")
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('```json\n{"a": "one '), F.col("turn").cast("string"), F.lit('", "b": "two"}\n```'))).otherwise("no reply")
    return c.select("conv_id", "turn", F.element_at(evidence.parse_keyed_reply(reply), F.lit("a")).alias("first"))


# --- the whole annotation -------------------------------------------------------------------------------------------

SETTINGS = Settings(topics=tuple(TOPICS), directions=tuple(DIRECTIONS), categories=CATEGORIES, designs=DESIGNS, empirical=("study", "dementia"), theory=("model", "研究"), ai=AI, pedagogy=PEDAGOGY, chinese=CHINESE)
_VALUE_SQL = f"least(1.0, 0.35 * {_count_sql('lt', AI)} + 0.25 * {_count_sql('lt', PEDAGOGY)} + 0.3 * {_count_sql('lt', CHINESE)})"
_METHOD_SQL = f"least(1.0, 0.3 * (CASE WHEN {_count_sql('lt', DESIGNS['survey'])} > 0 THEN 1 ELSE 0 END + CASE WHEN {_count_sql('lt', DESIGNS['experiment'])} > 0 THEN 1 ELSE 0 END) + CASE WHEN {_count_sql('lt', ('study', 'dementia'))} > 0 THEN 0.4 ELSE 0 END + CASE WHEN {_count_sql('lt', ('model', '研究'))} > 0 THEN 0.2 ELSE 0 END)"


@query(f"""WITH {STUDIES_SQL}, q AS (SELECT id, title, title || ' ' || text AS text, discovery_date, citation_count FROM s), n AS (SELECT *, {_NORMAL.replace("title || ' ' || abstract", "text")} AS m, {_neutral_sql("text")} AS t, {_neutral_sql("title")} AS nt, lower(text) AS lt FROM q),
g AS (SELECT *, {_DOMAIN_SQL} AS tier, {_EDU_SQL} AS e, {_OTHER_SQL} AS o, {_count_sql("lt", domain.CHINESE_FOCUS)} > 0 AS focus, date_diff('day', CAST(discovery_date AS DATE), DATE '{TODAY}') AS age FROM n),
h AS (SELECT id, greatest({", ".join(_hit_sql(t)[0] for t in TOPICS)}) AS topic, {_METHOD_SQL} AS method, {_VALUE_SQL} AS value, CASE WHEN discovery_date LIKE '%-01-01' THEN 0.3 WHEN age < 0 THEN 0.2 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.85 WHEN age <= 90 THEN 0.6 WHEN age <= 365 THEN 0.35 ELSE 0.15 END AS fresh,
  0.5 + CASE WHEN id % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.2 ELSE 0 END AS complete, least(1.0, log10(citation_count + 1) / 2) AS cite FROM g)
SELECT id, CAST(topic AS DOUBLE) AS topic, CAST(round(method, 3) AS DOUBLE) AS method, CAST(round(value, 3) AS DOUBLE) AS value, CAST(round(0.34 * topic + 0.20 * fresh + 0.16 * method + 0.18 * value + 0.07 * round(complete, 3) + 0.05 * cite, 4) AS DOUBLE) AS score FROM h""")
def h4k_annotated_papers(spark: SparkSession, sf: str) -> DataFrame:
    rows = studies(spark, sf).select("id", "title", F.col("text").alias("abstract"), F.when(F.col("id") % 2 == 0, "10.1/x").alias("doi"), F.lit(None).cast("string").alias("url"), (F.col("id") % 3 == 0).alias("open_access"), F.col("discovery_date").alias("published_online"), "citation_count")
    return annotate(rows, SETTINGS, TODAY).select("id", "topic", F.round("method", 3).alias("method"), F.round("value", 3).alias("value"), "score")
