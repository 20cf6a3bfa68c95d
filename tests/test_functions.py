import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, evidence, identifiers, language, topics


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_doi(spark):
    cases = {"https://doi.org/10.1234/AbC.": "10.1234/abc", "doi: 10.12345/x)": "10.12345/x", "10.1/x": None, "": None, None: None, "no": None}
    assert apply(spark, list(cases), identifiers.normalize_doi) == list(cases.values())


def test_issn(spark):
    cases = {"1234567x": "1234-567X", "1234-5678": "1234-5678", "123": None, None: None}
    assert apply(spark, list(cases), identifiers.normalize_issn) == list(cases.values())


def test_title(spark):
    cases = {"The <i>Éffect</i> of a Test: part-2": "effect of test part 2", "Ｆｕｌｌ　ｗｉｄｔｈ！": "full width", "": "", None: ""}
    assert apply(spark, list(cases), identifiers.normalize_title) == list(cases.values())


def test_placeholder(spark):
    cases = {"None-None": None, "12-None": "12", "12–15": "12–15", "n/a": None, " 7 ": "7", "-": None, "1-": "1", None: None}
    assert apply(spark, list(cases), identifiers.clean_placeholder) == list(cases.values())


def test_quartile_and_year(spark):
    assert apply(spark, ["Q2", "2区", "三区", "x", None], identifiers.norm_quartile) == ["Q2", "Q2", "Q3", None, None]
    assert apply(spark, ["2019, 2021 v", "x", None], identifiers.year_of) == [2021, None, None]


@pytest.mark.parametrize(("value", "precision", "ms"), [("2020", "year", 1593561600000), ("2020-03", "month", 1584230400000), ("2020-03-02", "day", 1583107200000), ("2020-01-01", "year", 1577836800000 + 182 * 86400000), ("x", None, None), (None, None, None)])
def test_dates(spark, value, precision, ms):
    assert apply(spark, [value], dates.date_precision) == [precision]
    assert apply(spark, [value], dates.date_to_ms) == [ms]


def test_best_date(spark):
    df = spark.createDataFrame([("2020-02-03", "2019-05", "2018"), ("2020", "2019-05-06", None), (None, None, "2018"), (None, None, None)], "o string, p string, i string")
    found = [r.b.kind if r.b else None for r in df.select(dates.best_pub_date(F.col("o"), F.col("p"), F.col("i")).alias("b")).collect()]
    assert found == ["online", "print", "issued", None]


def test_date_parts(spark):
    assert apply(spark, [[2020, 3, 2], [2020, 3], [2020], [2020, 13, 1], [2020, 2, 40], None, []], dates.date_from_parts, "array<int>") == ["2020-03-02", "2020-03", "2020", "2020", "2020-02", None, None]


def test_instants(spark):
    same = apply(spark, ["2024-05-01 10:00:00", "2024-05-01T10:00:00Z", "2024-05-01T18:00:00+08:00"], dates.to_iso_utc)
    assert same == ["2024-05-01T10:00:00.000Z"] * 3
    assert apply(spark, ["2024-05-01T18:00:00Z"], lambda c: dates.local_day(dates.parse_instant(c))) == ["2024-05-02"]


def test_languages(spark):
    cases = {"语言教学研究": "zh", "かな": "other", "Emoji pragmatics": "en", "Kajian bahasa dalam kelas": "id", "Xyz qwe": "unknown", "": "unknown", None: "unknown", "Привет": "other"}
    assert [x.language for x in apply(spark, list(cases), lambda c: language.detect_language(c, True))] == list(cases.values())


def test_resolve_language(spark):
    rows = [("语言教学研究", None, "en", None), ("The study", None, None, None), ("Xyz", "the results of this study are", None, None), ("The study", None, "de", "zh"), ("Xyz", None, "fr", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, a string, s string, m string").coalesce(1)
    found = [(r.x.language, r.x.source) for r in df.select(language.resolve_language(*(F.col(c) for c in "tasm")).alias("x")).collect()]
    assert found == [("zh", "title"), ("en", "title"), ("en", "abstract"), ("zh", "manual"), ("other", "publisher"), ("unknown", "unknown")]


def test_terms_have_boundaries(spark):
    text = lambda c: topics.matchable(c)
    assert apply(spark, ["An AI-based tool", "specifically", "second-language (L2) use"], lambda c: topics.count_terms(text(c), ("ai", "call", "second language", "l2"))) == [1, 0, 2]


def test_topic_score(spark):
    topic = topics.Topic("sla", ("second language acquisition", "interlanguage"), ("second language", "interlanguage"), excluded=("cache",), generic=frozenset({"language"}))
    found = apply(spark, ["interlanguage in second language acquisition", "second helpings", "interlanguage cache", None], lambda c: topics.topic_score(topics.matchable(c), topic))
    assert found == [1.0, 0.0, 0.0, 0.0]


def test_sentences(spark):
    assert apply(spark, ["One. Two! 三。x", "a" * 401 + "."], evidence.split_sentences) == [["One.", "Two!", "三。"], ["a" * 300, "a" * 101 + "."]]


def test_grounding(spark):
    df = spark.createDataFrame([("see [S1][S9] and [S1]", ["S1", "S2"])], "r string, s array<string>")
    v = df.select(evidence.validate_grounding(F.col("r"), F.col("s")).alias("v")).first().v
    assert (v.cited, v.bogus, v.coverage) == (["S1"], ["S9"], 0.5)


def test_numbers_kept(spark):
    df = spark.createDataFrame([("N=42, 3.5% and 7", "42, then 7")], "s string, t string")
    assert df.select(evidence.missing_numbers(F.col("s"), F.col("t")).alias("m")).first().m == ["3.5%"]


def test_sections(spark):
    text = "Title line\n" + "a" * 250 + "\nMETHODS\n" + "b" * 30 + "\nRESULTS\n" + "c" * 100
    found = apply(spark, [text, "", None], lambda c: evidence.detect_sections(c, "^[A-Z]{4,}$"))
    assert [(s.heading, len(s.text)) for s in found[0]] == [("", 261), ("METHODS", 139)]
    assert found[1:] == [[], None]


def test_model_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cd")], "subject long, text string")
    found = evidence.apply_model(df, lambda texts: [t[::-1] for t in texts], 2).collect()
    assert {(r.subject, r.reply) for r in found} == {(1, "ba"), (2, "dc")}


def test_reply(spark):
    assert apply(spark, ['```json\n{"1": "a", "2": "b"}\n```'], evidence.parse_keyed_reply) == [{"1": "a", "2": "b"}]


def test_terms_of_two_scripts(spark):
    text = lambda c: topics.matchable(c)
    assert apply(spark, ["国际中文教学研究", "AI教学", None], lambda c: topics.count_terms(text(c), ("教学", "中文", "ai"))) == [2, 2, 0]
    topic = topics.Topic("zh", ("国际中文教学",), ("教学", "中文"))
    assert apply(spark, ["国际中文教学研究", "研究"], lambda c: topics.topic_score(text(c), topic)) == [1.0, 0.0]


def test_gates(spark):
    tech = topics.Topic("edtech", ("learning analytics",), ("chatbot", "learning analytics"), gated=True)
    sla = topics.Topic("sla", ("second language acquisition",), ("l2", "second language"))

    def hit(topic):
        return lambda c: topics.topic_hit(topics.matchable(c), topic, topics.about_of(c, F.lit("A note")))

    found = apply(spark, ["A chatbot for dental patients", "A chatbot for students", "A chatbot"], hit(tech))
    assert [(r.score > 0, r.cross) for r in found] == [(False, True), (True, False), (False, True)]
    found = apply(spark, ["L2 regularization", "L2 in a second language class"], hit(sla))
    assert [r.score > 0 for r in found] == [False, True]


def test_entities_and_names(spark):
    assert apply(spark, ["&amp;lt; &#65;&#x4E2D;&#0; &ndash;", None], lambda c: identifiers.decode_entities(c)) == ["&lt; A中&#0; –", None]
    assert apply(spark, ["a 0; b 1；c [1,2]"], lambda c: identifiers.clean_authors(c)) == [["a 0", "b 1", "c"]]
