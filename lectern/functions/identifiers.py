"""Identifiers, titles, names and placeholders of bibliographic records, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as records have it, the ideographic and zero-width spaces included.
SPACE = r"[\s  -​　]+"
#: Entities that occur in records (fixed values).
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lsquo;": "‘",
    "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&middot;": "·", "&times;": "×", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&deg;": "°", "&amp;": "&",
}
#: Words that stand for "no value" in volume, issue and page fields (fixed values).
PLACEHOLDER = r"(?i)^(none|null|nil|nan|undefined|n/?a|unknown|-+|—+|–+|\?+|\.+)$"
#: Journal names that are written in more than one way (fixed values).
JOURNAL_ALIASES = {
    "pragmatics & cognition": "pragmatics and cognition",
    "the modern language journal": "modern language journal",
    "computers & education": "computers and education",
    "language learning & technology": "language learning and technology",
    "the language learning journal": "language learning journal",
    "zhongguo yuwen": "中国语文",
}


def _accents() -> tuple[str, str]:
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(trimmed(c) != "", trimmed(c))


def normalize_doi(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(trimmed(c), r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    clean = F.regexp_replace(F.lower(trimmed(bare)), r"[.,;)\]]+$", "")
    return F.when(clean.rlike(r"^10\.[0-9]{4,9}/[^\s]+$"), clean)


def normalize_issn(c: Column) -> Column:
    kept = F.regexp_replace(F.upper(c), "[^0-9X]", "")
    return F.when(F.length(kept) == 8, F.concat(F.substring(kept, 1, 4), F.lit("-"), F.substring(kept, 5, 4)))


def strip_diacritics(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), *_accents())


def decode_entities(c: Column) -> Column:
    """Named entities of the list and numeric ones, decimal or hexadecimal; &amp; last, so that nothing is decoded twice."""
    number = lambda hexadecimal, digits: F.conv(digits, 16, 10).cast("int") if hexadecimal else digits.cast("int")

    def numeric(x: Column, hexadecimal: bool) -> Column:
        mark, digits = ("&#[xX]", "[0-9a-fA-F]{1,6}") if hexadecimal else ("&#", "[0-9]{1,7}")
        found = F.array_distinct(F.regexp_extract_all(x, F.lit(f"{mark}({digits});"), F.lit(0)))
        code = lambda e: number(hexadecimal, F.regexp_extract(e, f"({digits});$", 1))
        sign = lambda e: F.when(code(e).between(1, 0x10FFFF) & ~code(e).between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")).otherwise(e)
        return F.when(F.contains(x, F.lit("&#")), F.aggregate(found, x, lambda t, e: F.replace(t, e, sign(e)))).otherwise(x)

    named = {k: v for k, v in ENTITIES.items() if k != "&amp;"}
    return F.replace(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), named.items(), numeric(numeric(c, True), False)), F.lit("&amp;"), F.lit("&"))


def normalize_title(c: Column) -> Column:
    """For comparison, not for display: no tags, accents, case, punctuation or articles; half-width letters."""
    wide, half = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    flat = F.lower(strip_diacritics(decode_entities(F.regexp_replace(c, "<[^>]+>", " "))))
    bare = F.regexp_replace(F.translate(flat, wide, half), r"[，。、；：？！“”‘’（）【】《》〈〉·—…,.;:?!\"'()\[\]{}<>\-_/\\|~`@#$%^&*+=]", " ")
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<![A-Za-z0-9_])(a|an|the)(?![A-Za-z0-9_])", " "), SPACE, " ")), F.lit(""))


def normalize_journal_name(c: Column) -> Column:
    name = F.trim(F.regexp_replace(F.lower(strip_diacritics(F.replace(F.regexp_replace(c, "<[^>]+>|[《》〈〉]", ""), F.lit("&amp;"), F.lit("&")))), SPACE, " "))
    alias = F.create_map(*(F.lit(x) for pair in JOURNAL_ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(alias, name), F.trim(F.regexp_replace(name, r"\s*\((online|print|electronic|internet)\)\s*$", "")), F.lit(""))


def dedup_key(doi: Column, issn: Column, title: Column, year: Column, record: Column) -> Column:
    """doi, else title with ISSN, else title alone; a record without either is known by the hash of all of it."""
    d, t, i, y = normalize_doi(doi), normalize_title(title), normalize_issn(issn), F.coalesce(year.cast("string"), F.lit(""))
    return (
        F.when(d.isNotNull(), F.concat(F.lit("doi:"), d))
        .when((t != "") & i.isNotNull(), F.concat(F.lit("ti:"), i, F.lit(":"), F.substring(t, 1, 120), F.lit(":"), y))
        .when(t != "", F.concat(F.lit("tt:"), F.substring(t, 1, 160), F.lit(":"), y))
        .otherwise(F.concat(F.lit("raw:"), F.sha2(record, 256)))
    )


def clean_abstract(c: Column) -> Column:
    flat = decode_entities(F.regexp_replace(c, "<[^>]+>", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(flat, r"(?i)^\s*(abstract|摘要)\s*[:：]?\s*", ""), SPACE, " "))
    return F.when(F.length(bare) >= 30, bare)


def is_placeholder(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "") | trimmed(c).rlike(PLACEHOLDER)


def clean_placeholder(c: Column) -> Column:
    """Null for a placeholder; of a range the placeholder parts go; all else stays as it is."""
    whole = trimmed(c)
    parts = F.transform(F.split(whole, r"\s*[-–—/]\s*"), trimmed)
    kept = F.filter(parts, lambda p: ~is_placeholder(p))
    return F.when(~is_placeholder(c), F.when(F.size(kept) == F.size(parts), whole).when(F.size(kept) > 0, F.array_join(kept, "-")))


def format_authors(c: Column) -> Column:
    """Names of array<struct<name, given, family, literal>>, empty ones left out."""
    full = lambda a: F.coalesce(blank_to_null(a["name"]), blank_to_null(F.concat_ws(" ", blank_to_null(a["given"]), blank_to_null(a["family"]))), blank_to_null(a["literal"]))
    return F.filter(F.transform(c, full), lambda x: x.isNotNull())


def split_list(c: Column) -> Column:
    """A list written with full or half-width commas or semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;；,，]"), trimmed), lambda x: x != "")


def base_arxiv_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"(?i)(?:arxiv\.org/abs/|arxiv:)?([a-z-]+/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})(v[0-9]+)?", 1), r"v[0-9]+$", "")


def doi_from_url(c: Column) -> Column:
    return normalize_doi(F.regexp_extract(F.url_decode(c), r"(?i)doi\.org/(10\.[0-9]{4,9}/[^\s?#]+)", 1))


def norm_quartile(c: Column) -> Column:
    chinese = F.translate(F.regexp_extract(c, "([一二三四])区", 1), "一二三四", "1234")
    found = F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)q\s*([1-4])", 1), F.lit("")), F.nullif(chinese, F.lit("")), F.nullif(F.regexp_extract(c, r"^\s*([1-4])\s*(区)?\s*$", 1), F.lit("")))
    return F.concat(F.lit("Q"), found)


def year_of(c: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(19|20)[0-9]{2}"), F.lit(0)), lambda y: y.cast("int")))


def fingerprint(c: Column) -> Column:
    return F.sha1(F.encode(F.coalesce(F.trim(c), F.lit("")), "UTF-8"))


def redact(c: Column, secrets: list[str] | None = None) -> Column:
    hidden = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("***")), secrets or [], c)
    return F.regexp_replace(hidden, r"(?i)bearer\s+[A-Za-z0-9._\-]+", "Bearer ***")


def classify_failure(message: Column, status: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(text.rlike("timeout|timed out|超时"), "timeout")
        .when((status == 429) | text.rlike("rate limit|too many|throttl"), "throttled")
        .when(text.rlike("parse|json|xml|unexpected token"), "parse")
        .when(status >= 400, "http")
        .when(text.rlike("network|econn|enotfound|socket|dns"), "network")
        .otherwise("unknown")
    )


def prune_fields(c: Column, longest: int = 2000) -> Column:
    """Of a map of fields: without the abstract and blank values, the others cut to `longest` characters."""
    return F.transform_values(F.map_filter(c, lambda k, v: (k != "abstract") & (F.trim(v) != "")), lambda k, v: F.substring(v, 1, longest))


# --- keys, titles and dates of other streams ------------------------------------------------------------------------


def stream_key(doi: Column, title: Column, year: Column, source: Column, source_id: Column) -> Column:
    """A record's key in the stream of new work: its DOI, else title and year, else the source's own number."""
    t = normalize_title(title)
    return F.when(normalize_doi(doi).isNotNull(), F.concat(F.lit("doi:"), normalize_doi(doi))).when(t != "", F.concat(F.lit("ft:"), F.substring(t, 1, 140), F.lit(":"), F.coalesce(year.cast("string"), F.lit("")))).otherwise(
        F.concat(F.lit("fs:"), source, F.lit(":"), source_id)
    )


def bulk_key(doi: Column, anthology_id: Column, key: Column) -> Column:
    """A record's key in a bulk file: its DOI, else its number in the anthology, else its BibTeX key."""
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), F.concat(F.lit("acid:"), F.nullif(anthology_id, F.lit(""))), F.concat(F.lit("aclbib:"), key))


def catalog_key(title: Column, year: Column) -> Column:
    """A contents row's key, the same as dedup_key() of a record without DOI and ISSN."""
    none = F.lit(None).cast("string")
    return dedup_key(none, none, title, year, F.coalesce(title, F.lit("")))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def clean_title(c: Column) -> Column:
    """A title for display: no tags, entities decoded, single spaces; null if nothing is left."""
    return F.nullif(collapse_ws(decode_entities(F.regexp_replace(c, "<[^>]+>", ""))), F.lit(""))


def clean_authors(c: Column) -> Column:
    """Authors of one string, parted by semicolons, without the numbers of their institutions as [1,2]."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;；]"), lambda a: trimmed(F.regexp_replace(a, r"\[[0-9,，\s]*\]", ""))), lambda a: a != "")


def split_authors(c: Column) -> Column:
    """Authors of a BibTeX field, parted by `and`."""
    return F.filter(F.transform(F.split(collapse_ws(c), r"(?i)\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")


def anthology_id(url: Column) -> Column:
    """The number of a paper in an anthology's address, such as 2020.acl-main.1 or P19-1001."""
    return F.nullif(F.regexp_extract(url, r"(?i)/((?:[0-9]{4}\.[a-z0-9_-]+\.[0-9]+)|(?:[a-z][0-9]{2}-[0-9]{4,5}))/?(?:\.pdf|\.bib)?$", 1), F.lit(""))


def norm_year(c: Column, anthology: Column | None = None) -> Column:
    """The first four digits of a year field, else those that begin an anthology's number."""
    own = F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), "([0-9]{4})", 1), F.lit(""))
    other = F.nullif(F.regexp_extract(F.coalesce(anthology, F.lit("")), r"^([0-9]{4})\.", 1), F.lit("")) if anthology is not None else F.lit(None).cast("string")
    return F.coalesce(own, other).cast("int")


#: English names of months in BibTeX files (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def norm_month(c: Column) -> Column:
    """A month as two digits from its name, the three letters of it, or its number; null for anything else."""
    s = F.regexp_replace(F.lower(collapse_ws(c)), r"\.$", "")
    names = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for name in {m, m[:3]} for x in (name, f"{i:02d}")))
    number = F.when(s.rlike("^[0-9]{1,2}$"), s.cast("int"))
    return F.coalesce(F.element_at(names, s), F.when(number.between(1, 12), F.lpad(number.cast("string"), 2, "0")))


def published_date_of(year: Column, month: Column) -> Column:
    """YYYY-MM, or YYYY without a month; never a day."""
    return F.when(year > 0, F.concat_ws("-", year.cast("string"), month))


def parse_issue(html: Column) -> Column:
    """struct<year, issue, label> of `2026年 第2期` in a page; null without one."""
    pattern = "([0-9]{4})\\s*年\\s*第\\s*([0-9]{1,2})\\s*期"
    year, issue = F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2)
    return F.when(year != "", F.struct(year.alias("year"), issue.alias("issue"), F.concat(year, F.lit("年第"), issue, F.lit("期")).alias("label")))


def parse_catalog_date(html: Column) -> Column:
    """The first day written as `2026年3月5日`, as an ISO date."""
    pattern = "([0-9]{4})年\\s*([0-9]{1,2})月\\s*([0-9]{1,2})日"
    part = lambda i: F.regexp_extract(html, pattern, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def keyword_list(c: Column) -> Column:
    """Names of array<struct<name, display_name>>, trimmed, without empty ones."""
    name = lambda k: F.trim(F.coalesce(F.nullif(k["name"], F.lit("")), k["display_name"], F.lit("")))
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,display_name:string>>")), name), lambda x: x != "")


def bib_doc_type(kind: Column) -> Column:
    """The kind of a record by its BibTeX type."""
    k = F.lower(kind)
    return F.when(k == "article", "journal-article").when(k.isin("inproceedings", "conference"), "conference-paper").when(k.isin("proceedings", "book"), k).when(k.isin("incollection", "inbook"), "book-chapter").when(k.isin("phdthesis", "mastersthesis"), "dissertation").otherwise("other")
