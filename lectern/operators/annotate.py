"""Settings of a reader, and papers annotated by them: topics, categories, methods, value, freshness and one score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import dates, domain, topics


@dataclass(frozen=True)
class Settings:
    """What a reader chooses.  Topics, directions, categories and signal words are their own; the numbers have defaults."""

    topics: tuple[topics.Topic, ...] = ()
    directions: tuple[topics.Direction, ...] = ()
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    designs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    empirical: tuple[str, ...] = ()
    theory: tuple[str, ...] = ()
    ai: tuple[str, ...] = ()
    pedagogy: tuple[str, ...] = ()
    chinese: tuple[str, ...] = ()
    zone: str = dates.ZONE
    brief_size: int = 50
    lookback_days: int = 30
    frontier_size: int = 3
    broad_technology: bool = True
    accept_extended: bool = False


def annotate(papers: DataFrame, settings: Settings, today: str) -> DataFrame:
    """papers (id, title, abstract, doi, url, open_access, published_online, citation_count, ...) with topics, cross_domain,
    category_ids, designs, the parts of the score and the score.

    Only rows that merge.only_changed() leaves need it anew.  The text that terms are matched in is made once a row.
    """
    text = F.concat_ws(" ", "title", "abstract")
    made = F.struct(text.alias("text"), topics.matchable(text).alias("m"), topics.about_of(text, F.col("title")).alias("about"))
    held = papers.withColumn("__v", F.explode(F.array(made)))
    with_hits = held.withColumn("__hits", F.explode(F.array(topics.topic_hits(F.col("__v.m"), list(settings.topics), F.col("__v.about"), settings.broad_technology))))
    scores = topics.scores_of(F.col("__hits"))
    method = topics.method_profile(F.col("__v.text"), settings.designs, settings.empirical, settings.theory)
    parts = {
        "topic": F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0)), "fresh": dates.freshness_score(F.col("published_online"), today), "method": method["score"],
        "value": domain.research_value(F.col("__v.text"), settings.ai, settings.pedagogy, settings.chinese), "complete": topics.completeness(F.col("abstract"), F.col("doi"), F.col("open_access"), F.col("url")),
        "cite": topics.citation_score(F.col("citation_count")),
    }
    told = {"topics": topics.infer_topics(F.col("__hits")), "cross_domain": topics.is_cross_domain(F.col("__hits")), "category_ids": topics.category_ids(scores, settings.categories), "designs": method["designs"]}
    annotated = with_hits.select(*papers.columns, *(c.alias(n) for n, c in told.items()), *(c.alias(n) for n, c in parts.items()))
    return annotated.withColumn("score", topics.paper_score(*(F.col(n) for n in parts)))
