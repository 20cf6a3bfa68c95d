"""A journal's standing in sentences: what speaks for it, what is missing, and the note that a reader sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.language import let
from lectern.operators.journals import NOTES, SSCI_CATALOGS

_ENTRY = ("load_ord", "catalog", "official", "edition", "year", "ssci_indexed", "quartiles", "zone")

# Sentences; {} is an edition in brackets, quartiles or a zone (fixed values).
ZH_CSSCI = "CSSCI 来源期刊目录{}收录"
ZH_EXTENDED = "CSSCI 扩展版（你已开启接受扩展版）"
ZH_EXTENDED_NOT = "CSSCI 扩展版按你的规则不算来源期刊"
ZH_CORE = "《中文核心期刊要目总览》{}收录"
ZH_REFERENCE = "参考候选清单显示该刊可能是 CSSCI 来源期刊{}，但未经官方核验"
ZH_REFERENCE_EXTENDED = "参考候选显示为 CSSCI 扩展版（你已开启接受扩展版，但仍未经官方核验）"
ZH_REFERENCE_EXTENDED_NOT = "参考候选显示为 CSSCI 扩展版，按你的规则不算来源期刊，且未经官方核验"
ZH_NONE = "未在 CSSCI／北大核心目录中匹配到该刊"
EN_RANKED = "已确认 SSCI 收录，且 JCR 分区为 {}（Q1–Q3）"
EN_EMERGING_RANKED = "清单标注该刊为 ESCI 而非 SSCI；ESCI 期刊即使有 JCR 分区也不能判为英文合格"
EN_REFERENCE_RANKED = "参考候选清单显示 JCR 分区为 {}{}，但未经官方核验"
EN_REFERENCE_SSCI = "、标注为 SSCI"
EN_RANKED_NOT_SSCI = "JCR 分区在 Q1–Q3，但无法确认该刊属于 SSCI 收录（JCR 也收录 SCIE 期刊）"
EN_RANK_LOW = "JCR 分区为 {}，不在 Q1–Q3 范围"
EN_EMERGING = "参考候选清单标注该刊为 ESCI，不是 SSCI，不能判为英文合格"
EN_NO_RANK = "已确认 SSCI 收录，但未录入 JCR 分区，无法判定 Q1–Q3"
EN_REFERENCE_NO_RANK = "参考候选显示可能为 SSCI，分区未录入，无法判定"
EN_NOT_FOUND = "未在 SSCI／JCR 目录中匹配到该刊，无法确认 SSCI 收录"
ZONE_GOOD = "已确认 SSCI 收录，且中科院分区为 {}（{}，该表 2026 年起不再更新）"
ZONE_REFERENCE = "参考名录显示中科院分区为 {}"
ZONE_NOT_SSCI = "中科院分区为 {}（在 1–3 区），但无法确认该刊被 SSCI 收录；按你的规则必须先确认 SSCI 收录，因此暂列待核验"
ZONE_LOW = "中科院分区为 {}，不在 1–3 区范围"
ZONE_NONE = "未录入中科院分区（该表 2026 年起不再更新，只能用可核实的历史数据）"
NO_YEAR = "年份未标"
TOO_LITTLE = "目录信息不足"
NO_JOURNAL = "未匹配到任何目录记录"
NO_JOURNAL_NOTE = "期刊未在本地目录中匹配到，无法核实 CSSCI／北大核心／SSCI 收录与分区，已列入「待核验候选」。"
REFERENCE_MORE = "。这些结论来自非官方参考线索（随程序附带的参考名录，或你导入的截图清单），不是官方目录。因此该刊的论文：可以进入主题优先的今日简报，但会醒目标注为「参考候选」；不计入「期刊条件合格」数量，也不会进入「期刊条件合格精选」页。"
ELIGIBLE_MORE = "。注意：该刊同时存在参考名录记录，但合格结论来自官方目录"


def fill(sentence: str, *values: Column) -> Column:
    """A sentence with its blanks filled."""
    parts = sentence.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value, F.lit(part)]
    return F.concat(*out)


def entries_of(entries: DataFrame) -> DataFrame:
    """(journal_id, entries): a journal's entries as a list in order of load; they are as many as there are catalogues and editions."""
    return entries.groupBy("journal_id").agg(F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("entries"))


def _some(sentence: Column, when: Column) -> Column:
    return F.when(when, F.array(sentence)).otherwise(F.array().cast("array<string>"))


def _chinese(e: Column, accept_extended: bool) -> Column:
    of = lambda official, *keys: F.filter(e, lambda c: (c["official"] == F.lit(official)) & c["catalog"].isin(*keys))
    bracket = lambda c: F.when(F.coalesce(c["edition"], F.lit("")) != "", F.concat(F.lit("（"), c["edition"], F.lit("）"))).otherwise("")
    cssci, extended, core = of(True, "cssci"), of(True, "cssci_ext"), of(True, "cn_core")
    own, own_extended = F.concat(of(False, "cssci"), of(False, "ref_cssci")), of(False, "ref_cssci_ext")
    each = lambda rows, sentence: F.transform(rows, lambda c: F.lit(sentence))
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.transform(cssci, lambda c: fill(ZH_CSSCI, bracket(c))), each(extended, ZH_EXTENDED) if accept_extended else none, F.transform(core, lambda c: fill(ZH_CORE, F.coalesce(c["edition"], F.lit("")))),
        F.transform(own, lambda c: fill(ZH_REFERENCE, bracket(c))), each(own_extended, ZH_REFERENCE_EXTENDED) if accept_extended else none,
    )
    nothing = (F.size(cssci) == 0) & (F.size(core) == 0) & (F.size(extended) == 0) & (F.size(own) == 0)
    missing = F.concat(none if accept_extended else each(extended, ZH_EXTENDED_NOT), none if accept_extended else each(own_extended, ZH_REFERENCE_EXTENDED_NOT), _some(F.lit(ZH_NONE), nothing))
    return F.struct(reasons.alias("reasons"), missing.alias("missing"))


def _english(e: Column) -> Column:
    has = lambda official, *keys: F.exists(e, lambda c: (c["official"] == F.lit(official)) & c["catalog"].isin(*keys))
    newest = lambda rows: F.get(F.array_sort(F.transform(rows, lambda c: F.struct((-F.coalesce(c["year"], F.lit(0))).alias("o"), c["load_ord"].alias("l"), c.alias("c")))), 0)["c"]
    own = F.get(F.filter(e, lambda c: c["official"] & (c["catalog"] == "ssci_jcr")), 0)
    reference = newest(F.filter(e, lambda c: ~c["official"] & c["catalog"].isin("ref_jcr", "ref_ssci", "ssci_jcr", "ref_esci")))
    zoned = F.filter(e, lambda c: c["zone"].isNotNull())
    zone = F.get(F.array_sort(F.transform(zoned, lambda c: F.struct((~c["official"]).alias("r"), (-F.coalesce(c["year"], F.lit(0))).alias("o"), c["load_ord"].alias("l"), c.alias("c")))), 0)["c"]
    facts = F.struct(
        F.exists(e, lambda c: c["official"] & c["catalog"].isin(*SSCI_CATALOGS) & F.coalesce(c["ssci_indexed"], F.lit(True))).alias("ssci"), has(False, "ssci_list", "ssci_jcr", "ref_jcr", "ref_ssci").alias("maybe"),
        has(False, "ref_ssci").alias("listed"), (has(False, "ref_esci") & ~has(False, "ref_ssci")).alias("emerging"),
        (own.isNull() & has(False, "ref_esci") & ~has(False, "ref_ssci", "ref_jcr", "ssci_jcr")).alias("only_emerging"), own.isNull().alias("by_reference"), F.coalesce(own, reference)["quartiles"].alias("quartiles"),
        zone["zone"].alias("zone"), zone["year"].alias("zone_year"),
    )

    def say(v: Column) -> Column:
        quartiles = F.array_join(v["quartiles"], "/")
        ranked = F.exists(v["quartiles"], lambda q: q.isin("Q1", "Q2", "Q3"))
        has_rank = F.coalesce(F.size(v["quartiles"]) > 0, F.lit(False))
        good = has_rank & ranked & v["ssci"] & ~v["by_reference"]
        emerging = has_rank & ~good & v["only_emerging"]
        # a rank that only a reference list knows, or of a journal that only a reference list calls indexed
        hinted = has_rank & ranked & ~good & ~emerging & (v["by_reference"] | v["maybe"])
        zone = F.concat(v["zone"].cast("string"), F.lit("区"))
        inside = F.coalesce(v["zone"].between(1, 3), F.lit(False))
        known = v["ssci"] | v["maybe"]
        reasons = F.concat(
            _some(fill(EN_RANKED, quartiles), good), _some(fill(EN_REFERENCE_RANKED, quartiles, F.when(v["listed"], EN_REFERENCE_SSCI).otherwise("")), hinted),
            _some(fill(ZONE_GOOD, zone, F.coalesce(v["zone_year"].cast("string"), F.lit(NO_YEAR))), inside & v["ssci"]), _some(fill(ZONE_REFERENCE, zone), inside & ~v["ssci"] & v["maybe"]),
        )
        esci = ~has_rank & known & ~v["ssci"] & v["emerging"]
        missing = F.concat(
            _some(F.lit(EN_EMERGING_RANKED), emerging), _some(F.lit(EN_RANKED_NOT_SSCI), has_rank & ranked & ~good & ~emerging & ~hinted), _some(fill(EN_RANK_LOW, quartiles), has_rank & ~ranked & ~emerging),
            _some(F.lit(EN_EMERGING), esci), _some(F.lit(EN_NO_RANK), ~has_rank & v["ssci"]), _some(F.lit(EN_REFERENCE_NO_RANK), ~has_rank & ~v["ssci"] & v["maybe"] & ~esci), _some(F.lit(EN_NOT_FOUND), ~has_rank & ~known),
            _some(fill(ZONE_NOT_SSCI, zone), inside & ~known), _some(fill(ZONE_LOW, zone), v["zone"].isNotNull() & ~inside), _some(F.lit(ZONE_NONE), v["zone"].isNull() & known),
        )
        return F.struct(reasons.alias("reasons"), missing.alias("missing"))

    return let(facts, say)


def explain(language: Column, status: Column, entries: Column, accept_extended: bool = False, has_journal: Column | None = None) -> Column:
    """struct<reasons, missing, note> of a standing (verdict()) from a journal's entries, null if it has none: the note says why
    where the standing is good, and else what is missing.  Without a journal nothing but that is missing."""
    none = F.array().cast(f"array<struct<{', '.join(f'{n}:{t}' for n, t in zip(_ENTRY, ('bigint', 'string', 'boolean', 'string', 'int', 'boolean', 'array<string>', 'int'), strict=True))}>>")
    said = let(F.coalesce(entries, none), lambda e: F.when(language == "zh", _chinese(e, accept_extended)).otherwise(_english(e)))
    begin = F.element_at(F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair)), status)
    text = lambda v: F.when(status.isin("eligible", "reference"), F.array_join(v["reasons"], "；")).when(status == "pending", F.when(F.size(v["missing"]) > 0, F.array_join(v["missing"], "；")).otherwise(TOO_LITTLE)).otherwise("")
    beside = F.coalesce(F.exists(entries, lambda c: ~c["official"]), F.lit(False))
    more = F.when(status == "reference", REFERENCE_MORE).when((status == "eligible") & beside, ELIGIBLE_MORE).otherwise("")
    found = let(said, lambda v: F.struct(v["reasons"].alias("reasons"), v["missing"].alias("missing"), F.concat(begin, text(v), more).alias("note")))
    if has_journal is None:
        return found
    nothing = F.struct(F.array().cast("array<string>").alias("reasons"), F.array(F.lit(NO_JOURNAL)).alias("missing"), F.lit(NO_JOURNAL_NOTE).alias("note"))
    return F.when(has_journal, found).otherwise(nothing)
