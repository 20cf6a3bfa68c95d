"""Landed responses of bibliographic services as records: one function each, from a path to a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.dates import date_from_parts
from lectern.functions.identifiers import (
    anthology_id, base_arxiv_id, bib_doc_type, blank_to_null, clean_abstract, doi_from_url, format_authors, norm_month, norm_year, normalize_doi, normalize_issn, published_date_of, split_authors,
)
from lectern.session import materialize, ship

_PARTS = "struct<`date-parts`: array<array<int>>>"
WORKS = (
    "message struct<items: array<struct<DOI: string, title: array<string>, author: array<struct<name: string, given: string, family: string, literal: string>>, "
    f"`container-title`: array<string>, ISSN: array<string>, abstract: string, `published-online`: {_PARTS}, `published-print`: {_PARTS}, issued: {_PARTS}, "
    "volume: string, issue: string, page: string, URL: string, publisher: string, type: string, language: string, `is-referenced-by-count`: bigint>>>"
)
GRAPH = (
    "results array<struct<doi: string, title: string, publication_date: string, language: string, cited_by_count: bigint, open_access: struct<is_oa: boolean, oa_status: string>, "
    "keywords: array<struct<display_name: string, score: double>>, topics: array<struct<display_name: string, score: double>>, concepts: array<struct<display_name: string>>, "
    "abstract_inverted_index: map<string, array<int>>, authorships: array<struct<author: struct<display_name: string>>>, "
    "primary_location: struct<source: struct<display_name: string, issn_l: string, issn: array<string>, host_organization_name: string>, pdf_url: string, license: string>, "
    "biblio: struct<volume: string, issue: string, first_page: string, last_page: string>, type: string>>"
)
PAPERS = "data array<struct<paperId: string, title: string, abstract: string, publicationDate: string, year: int, externalIds: map<string,string>, authors: array<struct<name: string>>>>"
ERIC = "response struct<docs: array<struct<id: string, title: string, author: array<string>, description: string, publicationtype: array<string>, publicationdateyear: int, subject: array<string>, url: string, peerreviewed: string>>>"
ATOM = "id string, title string, summary string, published string, doi string, journal_ref string, author array<struct<name: string>>"
IEEE = "articles array<struct<article_number: string, title: string, abstract: string, content_type: string, publication_date: string, publication_year: string, doi: string>>"


def _date(c: Column) -> Column:
    return date_from_parts(F.get(c["date-parts"], 0))


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works with three dates at their true precision; records without a title are left out."""
    w = spark.read.schema(WORKS).json(path, multiLine=True).select(F.explode("message.items").alias("w")).select("w.*")
    online, print_ = _date(F.col("published-online")), _date(F.col("published-print"))
    authors = format_authors(F.col("author"))
    return w.select(
        normalize_doi(F.col("DOI")).alias("doi"), blank_to_null(F.get("title", 0)).alias("title"), authors.alias("authors"), F.get("container-title", 0).alias("journal_name"),
        normalize_issn(F.get("ISSN", 0)).alias("issn"), clean_abstract(F.col("abstract")).alias("abstract"), online.alias("published_online"), print_.alias("published_print"),
        F.coalesce(_date(F.col("issued")), online, print_).alias("issued_date"), "volume", "issue", F.col("page").alias("pages"), F.col("URL").alias("url"), "publisher", "type",
        "language", F.col("is-referenced-by-count").alias("citation_count"),
    ).where("title is not null")


def rebuild_abstract(index: Column) -> Column:
    """The text of an inverted index word -> places."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return blank_to_null(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "))


def by_score(items: Column, most: int) -> Column:
    order = F.array_sort(F.transform(items, lambda k: F.struct((-F.coalesce(k["score"], F.lit(0.0))).alias("s"), k["display_name"].alias("n"))))
    return F.slice(F.transform(order, lambda x: x["n"]), 1, most)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.schema(GRAPH).json(path, multiLine=True).select(F.explode("results").alias("w")).select("w.*")
    return w.select(
        normalize_doi(F.col("doi")).alias("doi"), blank_to_null(F.col("title")).alias("title"), rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.col("publication_date").alias("issued_date"), "language", F.col("cited_by_count").alias("citation_count"), F.col("open_access.is_oa").alias("open_access"),
        F.col("open_access.oa_status").alias("oa_status"), by_score(F.col("keywords"), 20).alias("keywords"), by_score(F.col("topics"), 8).alias("topics"),
        F.slice(F.transform("concepts", lambda c: c["display_name"]), 1, 6).alias("concepts"),
        F.filter(F.transform("authorships", lambda a: blank_to_null(a["author"]["display_name"])), lambda a: a.isNotNull()).alias("authors"),
        F.col("primary_location.source.display_name").alias("journal_name"), normalize_issn(F.coalesce("primary_location.source.issn_l", F.get("primary_location.source.issn", 0))).alias("issn"),
        F.filter(F.transform("primary_location.source.issn", normalize_issn), lambda i: i.isNotNull()).alias("issn_list"), F.col("primary_location.source.host_organization_name").alias("publisher"),
        F.col("primary_location.pdf_url").alias("pdf_url"), F.col("primary_location.license").alias("license"), F.col("biblio.volume").alias("volume"), F.col("biblio.issue").alias("issue"),
        F.nullif(F.concat_ws("-", "biblio.first_page", "biblio.last_page"), F.lit("")).alias("pages"), "type",
    ).where("title is not null")


def read_papers(spark: SparkSession, path: str, since: str, until: str, most: int) -> DataFrame:
    """Papers dated in the range or not at all, the newest first."""
    w = spark.read.schema(PAPERS).json(path, multiLine=True).select(F.explode("data").alias("w")).select("w.*")
    date = F.col("publicationDate")
    kept = w.where(F.col("title").isNotNull() & (date.isNull() | date.between(since, until))).orderBy(date.desc_nulls_last(), "paperId").limit(most)
    return kept.select(normalize_doi(F.element_at("externalIds", F.lit("DOI"))).alias("doi"), "title", "abstract", date.alias("issued_date"), F.transform("authors", lambda a: a["name"]).alias("authors"))


def read_eric(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.schema(ERIC).json(path, multiLine=True).select(F.explode("response.docs").alias("w")).select("w.*")
    kinds = F.lower(F.array_join("publicationtype", " "))
    kind = F.when(kinds.contains("journal"), "journal-article").when(kinds.contains("report"), "report").when(kinds.contains("dissertation"), "dissertation").otherwise("other")
    return w.select("id", "title", F.col("author").alias("authors"), F.col("description").alias("abstract"), kind.alias("doc_type"), F.col("publicationdateyear").cast("string").alias("published_date"), doi_from_url(F.col("url")).alias("doi"), F.slice("subject", 1, 20).alias("subjects"), (F.col("peerreviewed") == "T").alias("peer_reviewed"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return w.select(base_arxiv_id(F.col("id")).alias("id"), flat(F.col("title")).alias("title"), flat(F.col("summary")).alias("abstract"), F.substring("published", 1, 10).alias("published_date"), normalize_doi(F.col("doi")).alias("doi"), F.col("journal_ref"), F.transform("author", lambda a: a["name"]).alias("authors"), F.lit("preprint").alias("doc_type"), F.lit(False).alias("peer_reviewed"))


def read_ieee(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.schema(IEEE).json(path, multiLine=True).select(F.explode("articles").alias("w")).select("w.*")
    day = F.when(F.col("publication_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("publication_date")).otherwise(F.col("publication_year"))
    kind = F.when(F.lower("content_type").contains("conference"), "conference-paper").when(F.lower("content_type").contains("journal"), "journal-article").otherwise("other")
    return w.select(F.col("article_number").alias("id"), "title", "abstract", kind.alias("doc_type"), day.alias("published_date"), normalize_doi(F.col("doi")).alias("doi"))


# --- BibTeX -------------------------------------------------------------------------------------------------------
#
# An entry runs from `@type{` or `@type(` to the bracket that closes it; a line inside may begin with @, too.  Files are read
# in splits, cut before a line-start @ by Spark's text source, and every split is scanned as if no entry were open at its
# start.  A first scan tells for each split what would be open at its end, whatever was open at its start; folded over a
# file's splits this gives the few that begin inside an entry, whose text is joined to the split before.

_START = re.compile(r"@[A-Za-z][A-Za-z0-9_-]*\s*([{(])")
_BRACKETS = {"{": re.compile(r"[{}]"), "(": re.compile(r"[()]")}
_FIELD = re.compile(r"([A-Za-z][\w-]*)\s*=\s*")
#: Splits that begin inside an entry are broadcast up to so many, else joined by a shuffle.
BROADCAST_SPLITS = 50_000


class BibScanner:
    """Entries of a text that comes in pieces cut before an @; `held` is the text of the entry that is open, `depth` its brackets."""

    def __init__(self) -> None:
        self.held: list[str] = []
        self.kind, self.depth = "", 0

    def feed(self, text: str) -> Iterator[str]:
        at = 0
        while True:
            if not self.depth:
                m = _START.search(text, at)
                if not m:
                    return
                self.kind, self.depth, start, at = m[1], 1, m.start(), m.end()
            else:
                start = at
            for m in _BRACKETS[self.kind].finditer(text, at):
                self.depth += 1 if m[0] == self.kind else -1
                if not self.depth:
                    break
            if self.depth:
                self.held.append(text[start:])
                return
            at = m.end()
            yield "".join([*self.held, text[start:at]])
            self.held = []


def bib_ends(text: str) -> dict[str, tuple[str, int]]:
    """What is open at the end of a split (kind of bracket, depth; nothing: "", 0) by what is open at its start: `` for
    nothing, `{2` for two braces; `{` alone says how much every deeper start grows."""

    def closed(at: int) -> tuple[str, int]:
        seen = []
        while (m := _START.search(text, at)) and m.start() not in known:
            seen.append(m.start())
            depth = 1
            for b in _BRACKETS[m[1]].finditer(text, m.end()):
                depth += 1 if b[0] == m[1] else -1
                if not depth:
                    break
            if depth:
                known.update(dict.fromkeys(seen, (m[1], depth)))
                return m[1], depth
            at = b.end()
        end = known[m.start()] if m else ("", 0)
        known.update(dict.fromkeys(seen, end))
        return end

    known: dict[int, tuple[str, int]] = {}
    ends = {"": closed(0)}
    for kind, pattern in _BRACKETS.items():
        balance = least = 0
        for b in pattern.finditer(text):
            balance += 1 if b[0] == kind else -1
            if balance < least:
                least = balance
                ends[f"{kind}{-least}"] = closed(b.end())
        ends[kind] = ("", balance)
    return ends


def _piece(value: str, place: int, block: int) -> str:
    """A piece with the @ at which it was cut."""
    return value if not place and not block else ("\n@" if place else "@") + value


def _by_split(batches: Iterator[pd.DataFrame], more: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(key, piece, is the first of its split), in order."""
    key, place = None, 0
    for batch in batches:
        for path, block, value, *rest in zip(batch["path"], batch["block"], batch["value"], *(batch[c] for c in more)):
            place = place + 1 if (path, block) == key else 0
            key = path, block
            yield key, _piece(value, place, block), not place, rest


def _split_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, block, ends): of a split at the start of its file only what is open at its end is of use."""

    def row() -> pd.DataFrame:
        found = {"": (scanner.kind if scanner.depth else "", scanner.depth)} if scanner else bib_ends("".join(texts))
        return pd.DataFrame({"path": [key[0]], "block": [key[1]], "ends": [{k: f"{kind}{depth}" if k in _BRACKETS or depth else "" for k, (kind, depth) in found.items()}]})

    key, texts, scanner = None, [], None
    for now, text, first, _ in _by_split(batches):
        if first:
            if key is not None:
                yield row()
            key, texts, scanner = now, [], None if now[1] else BibScanner()
        if scanner:
            for _ in scanner.feed(text):
                pass
        else:
            texts.append(text)
    if key is not None:
        yield row()


def _fold_file(splits: pd.DataFrame) -> pd.DataFrame:
    """(path, block, chain, inside) of the splits that begin inside an entry, and of those in which these entries begin."""
    out, state, head = [], "", None
    for path, block, ends in splits.sort_values("block")[["path", "block", "ends"]].itertuples(index=False):
        ends = dict(ends)
        if state:
            if head[0] != head[2]:
                out.append((path, head[0], head[0], False))
                head = head[0], head[1], head[0]
            out.append((path, block, head[0], True))
        else:
            head = block, None, None
        if not state or state in ends:
            state = ends[state]
        else:
            state = f"{state[0]}{int(state[1:]) + int(ends[state[0]])}"
    return pd.DataFrame(out, columns=["path", "block", "chain", "inside"])


def bib_fields(entry: str) -> dict[str, str]:
    """Kind, key and fields of one entry; values in braces (nested too), quotes or bare, joined by #."""
    head = re.match(r"@?([A-Za-z][\w-]*)\s*[{(]\s*([^,\s]*)\s*,", entry)
    if not head or head[1].lower() in ("string", "preamble", "comment"):
        return {}
    out, at = {"kind": head[1].lower(), "key": head[2]}, head.end()
    while m := _FIELD.search(entry, at):
        at, value = m.end(), ""
        while at < len(entry):
            if entry[at] == "{":
                depth, end = 0, at
                while end < len(entry):
                    depth += (entry[end] == "{") - (entry[end] == "}")
                    end += 1
                    if not depth:
                        break
                value, at = value + entry[at + 1 : end - 1], end
            elif entry[at] == '"':
                end = entry.find('"', at + 1)
                end = len(entry) if end < 0 else end
                value, at = value + entry[at + 1 : end], end + 1
            else:
                bare = re.compile(r"[^,#}\s]*").match(entry, at)
                value, at = value + bare[0], bare.end()
            more = re.compile(r"\s*#\s*").match(entry, at)
            if not more:
                break
            at = more.end()
        out.setdefault(m[1].lower(), re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip())
        comma = entry.find(",", at)
        if comma < 0:
            break
        at = comma + 1
    return out


_ENTRIES = "kind string, key string, fields map<string,string>, path string, block long, chain long, text string"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries; of splits in a chain also the text that goes on in the next one or came from the one before."""

    def made(entries: list[str], rest: list[tuple]) -> pd.DataFrame:
        found = [f for t in entries if (f := bib_fields(t))]
        rows = [(f.pop("kind"), f.pop("key"), f, None, None, None, None) for f in found] + [(None, None, None, *r) for r in rest]
        return pd.DataFrame(rows, columns=["kind", "key", "fields", "path", "block", "chain", "text"]).astype({"block": "Int64", "chain": "Int64"})

    def left() -> list:
        if key is None or not (scanner.held or inside):
            return []
        return [(*key, chain, "".join(inside or scanner.held))] if chain is not None else []

    key, scanner, chain, inside, entries, rest = None, BibScanner(), None, [], [], []
    for now, text, first, (of, within) in _by_split(batches, ("chain", "inside")):
        if first:
            rest += left()
            if chain is None and scanner.held:  # the file ends in an entry
                entries.append("".join(scanner.held))
            key, scanner, inside, chain = now, BibScanner(), [], None if pd.isna(of) else int(of)
        if chain is not None and within:
            inside.append(text)
        else:
            entries += scanner.feed(text)
        if len(entries) >= 1_000:
            yield made(entries, rest)
            entries, rest = [], []
    rest += left()
    if chain is None and scanner.held:
        entries.append("".join(scanner.held))
    yield made(entries, rest)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, doc_type, title, authors, year, issued_date, doi, url, anthology_id, fields) of entries with a key and a
    title; gz files too.  The year is that of the entry, else that of its number in the anthology.

    The rows are the same wherever files are cut into splits.  Each split is read twice, first for what is open at its end;
    a split is at most spark.sql.files.maxPartitionBytes, of a file that can't be cut only the open entry is held.
    """
    ship(spark)
    pieces = spark.read.text(path, lineSep="\n@").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    ends = pieces.mapInPandas(_split_ends, "path string, block long, ends map<string,string>")
    chains = materialize(ends.groupBy("path").applyInPandas(_fold_file, "path string, block long, chain long, inside boolean"), "chains")
    n = chains.limit(BROADCAST_SPLITS + 1).count()
    if n <= BROADCAST_SPLITS:
        marked = pieces.join(F.broadcast(chains), ["path", "block"], "left")
    else:
        placed = pieces.withColumn("place", F.monotonically_increasing_id())
        marked = placed.join(chains, ["path", "block"], "left").repartition("path", "block").sortWithinPartitions("path", "block", "place")
    found = marked.select("path", "block", "value", "chain", "inside").mapInPandas(_entries, _ENTRIES)
    raw = found.where("kind is not null")
    if n:
        joined = found.where("text is not null").groupBy("path", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("texts"))
        value = F.array_join(F.transform("texts", lambda t: t["text"]), "\n")
        again = joined.select(F.concat_ws("#", "path", "chain").alias("path"), F.lit(0).cast("long").alias("block"), value.alias("value"), F.lit(None).cast("long").alias("chain"), F.lit(False).alias("inside"))
        raw = raw.unionByName(again.mapInPandas(_entries, _ENTRIES).where("kind is not null"))
    f = lambda name: F.element_at("fields", F.lit(name))
    number = anthology_id(f("url"))
    year, month = norm_year(f("year"), number), norm_month(f("month"))
    return raw.select(
        "key", "kind", bib_doc_type(F.col("kind")).alias("doc_type"), f("title").alias("title"), split_authors(f("author")).alias("authors"), year.cast("string").alias("year"),
        published_date_of(year, month).alias("issued_date"), normalize_doi(f("doi")).alias("doi"), f("url").alias("url"), number.alias("anthology_id"), "fields",
    ).where("key <> '' and title <> ''")
