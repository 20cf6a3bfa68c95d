"""The text in which terms are matched, and how often it is made."""

import re

from pyspark.sql import functions as F

from lectern.functions import domain, topics


def test_as_two_plain_replacements(spark):
    texts = ["", " ", "-", "a", " a ", "a  b", "a\tb", "a\n\n b", "a-b", "a--b -c-", "ÉA é\x0bx", "x\x0c\ry", "汉语\U0001f600z", "a\xa0b", "a\x01b", "[^]\\{2,}|", None, "end. ", "A_b\x85c", "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", topics.matchable(F.col("t")).alias("m")).orderBy("i").collect()]
    low = [(t or "").lower() for t in texts]
    spaces = r"[ \t\n\x0b\f\r-]"
    assert got == [" " + re.sub(f"{spaces}+", " ", re.sub(r"[^a-z0-9 \t\n\x0b\f\r-]", " \x01 ", t)) + " \x02" + t for t in low]


def test_texts_are_lowered_once(spark):
    focus = spark.createDataFrame([("About Pinyin",), ("none",), (None,)], "t string").select(domain.has_chinese_focus(F.col("t")).alias("f"))
    assert [r.f for r in focus.collect()] == [True, False, False]
    plan = focus._jdf.queryExecution().analyzed().toString()
    assert plan.index("lower(") < plan.index("lambdafunction") and "lower(" not in plan[plan.index("lambdafunction(") :]


def test_classes_are_made_of_single_signs(spark):
    """Ranges and predefined classes are ten times slower over long texts."""
    plan = spark.range(1).select(topics.matchable(F.lit("x"))).select("*")._jdf.queryExecution().analyzed().toString()
    assert "a-z" not in plan and "abcdefghijklmnopqrstuvwxyz0123456789" in plan
