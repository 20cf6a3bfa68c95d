"""Topic evidence and scores.  Topics, domain terms and signals are arguments: a caller brings their own lists."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import domain
from lectern.functions.dates import date_precision, date_to_ms
from lectern.functions.language import let


#: Words that every topic's keywords hold, and markers that mean other things elsewhere (fixed values).
GENERIC = frozenset((
    "language", "languages", "education", "educational", "teaching", "learning", "learn", "teacher", "teachers", "learner", "learners", "student", "students",
    "research", "study", "studies", "practice", "practices", "classroom", "classrooms", "instruction", "instructional", "curriculum", "assessment",
    "development", "analysis", "review", "effect", "effects", "role", "use", "using", "based", "语言", "教育", "教学", "学习", "学习者", "教师", "学生", "研究",
    "课程", "课堂", "实践", "发展", "影响", "作用", "分析", "调查", "方法", "模式", "策略",
))
_SPACES = r"\t\n\x0B\f\r\-"  # what counts as a space beside it
AMBIGUOUS = frozenset(("l1", "l2", "uptake", "recast"))


@dataclass(frozen=True)
class Topic:
    """Keywords find a topic, markers prove it (without any, telling keywords do); `excluded` terms rule it out.

    `gated` asks for a study of language or education; `focused` for Chinese as the object where only markers of `loose`
    are met.
    """

    slug: str
    keywords: tuple[str, ...]
    markers: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    gated: bool = False
    focused: bool = False
    loose: frozenset[str] = field(default_factory=frozenset)
    generic: frozenset[str] = GENERIC


def tokenize(keyword: str) -> list[str]:
    """Latin words of three or more signs and runs of two or more Chinese characters."""
    low = keyword.lower()
    return [w for w in re.split(r"[^a-z0-9'-]+", low) if len(w) > 2] + re.findall("[一-鿿]{2,}", low)


def matchable(text: Column) -> Column:
    """Lower-case text in which ASCII terms stand between spaces (hyphens are spaces, other signs part words), and behind it
    the text as it was, for terms with other letters.

    Materialise it before matching many terms: Catalyst would else compute it anew for each.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    # sign by sign a class is one look into a table, and single spaces, most of all, stay as they are
    parted = F.regexp_replace(low, f"[^{string.ascii_lowercase}{string.digits} {_SPACES}]", " \u0001 ")
    spaced = F.regexp_replace(parted, f"[ {_SPACES}]{{2,}}|[{_SPACES}]", " ")
    return F.concat(F.lit(" "), spaced, F.lit(" \u0002"), low)


def _needle(term: str) -> str:
    """A term as it must stand in matchable() text: an ASCII one between spaces, another one anywhere."""
    low = term.lower().strip()
    return " " + re.sub(r"[\s-]+", " ", re.sub(r"([^a-z0-9\s-])", " \x01 ", low)).strip() + " " if low.isascii() else low


def _terms(terms) -> Column:
    return F.array(*(F.lit(_needle(t)) for t in terms)) if terms else F.array().cast("array<string>")


def has_term(text: Column, term: str) -> Column:
    """Of matchable() text; a term with letters beyond ASCII counts anywhere in it."""
    return F.contains(text, F.lit(_needle(term)))


def count_terms(text: Column, terms) -> Column:
    return F.size(F.filter(_terms(terms), lambda t: F.contains(text, t)))


def markers_of(topic: Topic) -> tuple[str, ...]:
    """A topic's markers; for one without, its keywords of two words, of Chinese, or of five signs or more."""
    telling = lambda k: k.lower() not in topic.generic and (len(tokenize(k)) >= 2 or re.search("[一-鿿]", k) or len(k) >= 5)
    return topic.markers or tuple(k for k in topic.keywords if telling(k))


def _keyword_ratio(text: Column, keyword: str, telling: list[str]) -> Column:
    """The share of a keyword's telling words found, if it stands as a whole or two of its several words do; else 0."""
    enough = lambda n: has_term(text, keyword) | ((n >= 2) & F.lit(len(telling) > 1))
    return let(count_terms(text, telling), lambda n: F.when(enough(n), n / F.lit(len(telling))).otherwise(0.0))


def topic_hit(text: Column, topic: Topic, about: Column | None = None, broad: bool = True) -> Column:
    """struct<score, markers, cross> of matchable() text: 0 to 1, three digits; the number of markers; off the field.

    The mean share of keywords' words found (a keyword of one telling word must stand as a whole, one of several needs two),
    the share of keywords with any, and a bonus for markers; 0 without a marker.  `about` is about_of() of the text, without
    which gates and ambiguous markers are not looked at.
    """
    ratios = []
    for keyword in topic.keywords:
        telling = [w for w in tokenize(keyword) if w not in topic.generic and len(w) > 3]
        if telling:
            ratios.append(_keyword_ratio(text, keyword, telling))
    flags = markers_of(topic)
    loose = [f for f in flags if f.lower() in topic.loose]
    unclear = [f for f in flags if f.lower() in AMBIGUOUS]

    def judge(v: Column) -> Column:
        n = v["spec"]
        total = F.aggregate(v["ratios"], F.lit(0.0), lambda a, r: a + r) / max(1, len(ratios))
        coverage = F.size(F.filter(v["ratios"], lambda r: r > 0)) / max(1, len(ratios))
        bonus = F.when(n == 1, 0.14).otherwise(F.least(n * 0.18, F.lit(0.6)))
        score = F.round(F.least(F.lit(1.0), 1.8 * total + 0.25 * coverage + bonus), 3)
        no, off = F.lit(False), F.lit(False)
        if topic.excluded:
            no = count_terms(text, topic.excluded) > 0
        if about is not None:
            if unclear:
                no = no | ((v["unclear"] == n) & ~about["in_domain"])
            if topic.gated:
                off = ~(~about["not_education"] & (about["in_domain"] | (F.lit(broad) & about["is_education"])))
            if topic.focused:
                off = off | (~about["chinese_focus"] & (v["loose"] == n))
        hit = (n > 0) & ~no
        return F.struct(F.when(hit & ~off, score).otherwise(0.0).alias("score"), n.alias("markers"), (hit & off).alias("cross"))

    found = F.struct(
        F.array(*ratios).cast("array<double>").alias("ratios"), count_terms(text, flags).alias("spec"), count_terms(text, loose).alias("loose"), count_terms(text, unclear).alias("unclear")
    )
    return let(found, judge)


def about_of(text: Column, title: Column) -> Column:
    """struct<in_domain, is_education, not_education, chinese_focus> of a text and its title, for the gates of topic_hit()."""
    both = F.struct(domain.language_domain(text).alias("d"), domain.research_object(text, title).alias("o"), domain.has_chinese_focus(text).alias("c"))
    return let(both, lambda v: F.struct(v["d"]["in_domain"].alias("in_domain"), v["o"]["is_education"].alias("is_education"), v["o"]["not_education"].alias("not_education"), v["c"].alias("chinese_focus")))


def topic_hits(text: Column, topics: list[Topic], about: Column | None = None, broad: bool = True) -> Column:
    """map<slug, struct<score, markers, cross>>."""
    return F.create_map(*(x for t in topics for x in (F.lit(t.slug), topic_hit(text, t, about, broad))))


def scores_of(hits: Column) -> Column:
    """map<slug, score> of topic_hits()."""
    return F.transform_values(hits, lambda k, v: v["score"])


def is_cross_domain(hits: Column) -> Column:
    """No topic has a score, but one that was met is off the field."""
    every = F.map_values(hits)
    return ~F.exists(every, lambda v: v["score"] > 0) & F.exists(every, lambda v: v["cross"])


def infer_topics(hits: Column, least: float = 0.35, k: int = 3) -> Column:
    """The k best slugs of at least the least score, with a marker and in the field; ties by name."""
    good = F.filter(F.map_entries(hits), lambda e: (e["value"]["score"] >= least) & (e["value"]["markers"] >= 1) & ~e["value"]["cross"])
    return F.slice(F.transform(F.array_sort(F.transform(good, lambda e: F.struct((-e["value"]["score"]).alias("s"), e["key"].alias("k")))), lambda e: e["k"]), 1, k)


def topic_score(text: Column, topic: Topic) -> Column:
    return topic_hit(text, topic)["score"]


def topic_scores(text: Column, topics: list[Topic]) -> Column:
    """map<slug, score>."""
    return F.create_map(*(x for t in topics for x in (F.lit(t.slug), topic_score(text, t))))


def top_topics(scores: Column, least: float = 0.35, k: int = 3) -> Column:
    """The k best slugs of at least the least score, best first, ties by name."""
    good = F.filter(F.map_entries(scores), lambda e: e["value"] >= least)
    return F.slice(F.transform(F.array_sort(F.transform(good, lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k")))), lambda e: e["k"]), 1, k)


def category_ids(scores: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    has = lambda slugs: reduce(lambda a, b: a | b, [F.coalesce(F.element_at(scores, s) > 0, F.lit(False)) for s in slugs])
    return F.array_compact(F.array(*(F.when(has(slugs), c) for c, slugs in categories.items())))


def method_profile(text: Column, designs: dict[str, tuple[str, ...]], empirical: tuple[str, ...], theory: tuple[str, ...]) -> Column:
    """struct<designs, score>: the designs with a term, and min(1, .3 designs + .4 empirical + .2 theory), plain substrings."""
    low = F.lower(text)
    any_of = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    found = F.array_compact(F.array(*(F.when(any_of(terms), name) for name, terms in designs.items())))
    score = F.least(F.lit(1.0), 0.3 * F.size(found) + F.when(any_of(empirical), 0.4).otherwise(0.0) + F.when(any_of(theory), 0.2).otherwise(0.0))
    return F.struct(found.alias("designs"), score.alias("score"))


def completeness(abstract: Column, doi: Column, oa: Column, url: Column) -> Column:
    one = lambda ok, w: F.when(ok, w).otherwise(0.0)
    return F.round(one(F.length(abstract) > 0, 0.5) + one(doi.isNotNull(), 0.2) + one(F.coalesce(oa, F.lit(False)), 0.2) + one(url.isNotNull(), 0.1), 3)


def citation_score(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(F.coalesce(count, F.lit(0)) + 1) / 2)


def paper_score(topic: Column, fresh: Column, method: Column, value: Column, complete: Column, cite: Column) -> Column:
    return F.round(0.34 * topic + 0.20 * fresh + 0.16 * method + 0.18 * value + 0.07 * complete + 0.05 * cite, 4)


def brief_score(topic: Column, fresh: Column, has_abstract: Column) -> Column:
    return F.round(0.62 * topic + 0.28 * fresh + 0.10 * F.when(has_abstract, 1.0).otherwise(0.0), 4)


def list_score(topic: Column, fresh: Column, has_abstract: Column, is_new: Column) -> Column:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.round(0.55 * topic + 0.33 * fresh + 0.07 * flag(has_abstract) + 0.05 * flag(is_new), 4)


def reason(slugs: Column, fresh: Column, has_abstract: Column, open_access: Column) -> Column:
    """A readable line of why a record was chosen."""
    return F.concat_ws(
        "；",
        F.when(F.size(slugs) > 0, F.concat(F.lit("主题："), F.array_join(slugs, "、"))),
        F.when(fresh >= 0.85, "近期发表"),
        F.when(has_abstract, "有摘要"),
        F.when(open_access, "开放获取"),
    )


def rule_summary(abstract: Column, designs: Column, slugs: Column) -> Column:
    """A preview, method labels and topics, made without a model."""
    return F.struct(F.substring(abstract, 1, 300).alias("preview"), designs.alias("designs"), slugs.alias("topics"))


# --- directions of new work -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Direction:
    """A field of new work: terms find it (two at least), one of its anchors proves it."""

    slug: str
    terms: tuple[str, ...]
    anchors: tuple[str, ...]


def hit_directions(text: Column, directions: list[Direction]) -> Column:
    """Slugs of the directions met by matchable() text."""
    return F.array_compact(F.array(*(F.when((count_terms(text, d.terms) >= 2) & (count_terms(text, d.anchors) >= 1), d.slug) for d in directions)))


def frontier_score(directions: Column, abstract: Column, published: Column, peer_reviewed: Column, today: str) -> Column:
    """Directions met, .5 for an abstract, .6 of how new it is (less for a coarse date), .15 for peer review; four digits."""
    at = date_to_ms(F.when(F.length(published) == 4, F.concat(published, F.lit("-07-01"))).when(F.length(published) == 7, F.concat(published, F.lit("-01"))).otherwise(published), F.lit("day"))
    age = F.greatest(F.lit(0.0), (F.unix_date(F.lit(today).cast("date")).cast("long") * 86_400_000 - at) / 86_400_000)
    base = F.when(age <= 30, 1.0).when(age <= 90, 0.8).when(age <= 365, 0.5).otherwise(0.25)
    recency = F.when(at.isNull(), 0.3).otherwise(base * F.when(date_precision(published) == "day", 1.0).otherwise(0.6))
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.round(F.size(directions) + flag(F.length(abstract) > 0, 0.5) + recency * 0.6 + flag(peer_reviewed, 0.15), 4)
