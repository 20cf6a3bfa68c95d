"""Sentences behind a journal's standing."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import reasons

KIND = "array<struct<load_ord:bigint,catalog:string,official:boolean,edition:string,year:int,ssci_indexed:boolean,quartiles:array<string>,zone:int>>"
ENTRY = "journal_id long, load_ord long, catalog string, official boolean, edition string, year int, ssci_indexed boolean, quartiles array<string>, zone int"


def said(spark, rows, language, status, accept_extended=False):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ENTRY)
    found = reasons.entries_of(df).select(reasons.explain(F.lit(language), F.lit(status), F.col("entries"), accept_extended).alias("s")).first()
    return (found.s.reasons, found.s.missing, found.s.note) if found else None


CASES = [
    ([("cssci", True, "2023", 2023, None, [], None), ("cn_core", True, None, None, None, [], None)], "zh", "eligible", ["CSSCI 来源期刊目录（2023）收录", "《中文核心期刊要目总览》收录"], []),
    ([("ref_cssci", False, "", None, None, [], None)], "zh", "reference", ["参考候选清单显示该刊可能是 CSSCI 来源期刊，但未经官方核验"], []),
    ([("ref_cssci_ext", False, "x", None, None, [], None)], "zh", "pending", [], [reasons.ZH_REFERENCE_EXTENDED_NOT, reasons.ZH_NONE]),
    ([("ref_ssci", False, "2026", 2026, None, ["Q1"], None)], "en", "reference", ["参考候选清单显示 JCR 分区为 Q1、标注为 SSCI，但未经官方核验"], [reasons.ZONE_NONE]),
    ([("ref_ssci", False, "2026", 2026, None, ["Q4"], None), ("ssci_jcr", True, "2020", 2020, True, ["Q2", "Q4"], 2)], "en", "eligible", ["已确认 SSCI 收录，且 JCR 分区为 Q2/Q4（Q1–Q3）", "已确认 SSCI 收录，且中科院分区为 2区（2020，该表 2026 年起不再更新）"], []),
    ([("ref_esci", False, "2024", 2024, None, ["Q1"], None)], "en", "pending", [], [reasons.EN_EMERGING_RANKED]),
    ([("ssci_list", True, "2024", 2024, False, [], 4)], "en", "pending", [], [reasons.EN_NOT_FOUND, "中科院分区为 4区，不在 1–3 区范围"]),
    ([("ssci_list", True, "2024", 2024, True, [], None)], "en", "pending", [], [reasons.EN_NO_RANK, reasons.ZONE_NONE]),
    ([("cn_core", True, None, None, None, [], 1)], "en", "pending", [], [reasons.EN_NOT_FOUND, "中科院分区为 1区（在 1–3 区），但无法确认该刊被 SSCI 收录；按你的规则必须先确认 SSCI 收录，因此暂列待核验"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_sentences(spark, case):
    rows, language, status, good, lacking = CASES[case]
    found = said(spark, rows, language, status)
    assert found[:2] == (good, lacking)
    more = {"reference": reasons.REFERENCE_MORE, "eligible": reasons.ELIGIBLE_MORE if any(not r[1] for r in rows) else ""}.get(status, "")
    assert found[2] == reasons.NOTES[status] + "；".join(good if status != "pending" else lacking) + more


def test_extended_lists_by_choice(spark):
    rows = [("cssci_ext", True, "2023", 2023, None, [], None), ("ref_cssci_ext", False, None, None, None, [], None)]
    assert said(spark, rows, "zh", "eligible", True)[:2] == ([reasons.ZH_EXTENDED, reasons.ZH_REFERENCE_EXTENDED], [])
    assert said(spark, rows, "zh", "pending")[1] == [reasons.ZH_EXTENDED_NOT, reasons.ZH_REFERENCE_EXTENDED_NOT]


def test_no_entries(spark):
    found = spark.range(1).select(reasons.explain(F.lit("en"), F.lit("excluded"), F.lit(None).cast(KIND)).alias("s")).first().s
    assert found.note == reasons.NOTES["excluded"]
    lost = spark.range(1).select(reasons.explain(F.lit("en"), F.lit("pending"), F.lit(None).cast(KIND), has_journal=F.lit(False)).alias("s")).first().s
    assert lost.missing == [reasons.NO_JOURNAL] and lost.note == reasons.NO_JOURNAL_NOTE
