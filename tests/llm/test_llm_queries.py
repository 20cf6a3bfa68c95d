import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import html_extract, queries, url_filter
from lectern.session import materialize
from tests.llm.test_small_cases import brute_bytes, brute_components, brute_contaminated, brute_rule, brute_words
from tests.oracle import connect, expected, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf)) == expected(connect(sf), queries.ORACLES[name])


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_op2_reads_every_page(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op2_html_text(spark, sf).collect()
    model = html_extract.train()
    assert len(found) == len(pages)
    for r in found:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == html_extract.main_text(pages[r.page_id].html, model)
        assert not any(c in r.text for c in "\t\r") and "  " not in r.text and r.text == "\n".join(x.strip() for x in r.text.split("\n"))


def test_op5_learns_only_from_the_rest(spark, sf):
    told = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op5_language_id(spark, sf).collect()
    assert len(found) == len(told)
    right = Counter()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in told[r.doc_id].text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.held_out and letters and told[r.doc_id].lang is not None:
            right[r.lang_pred == told[r.doc_id].lang] += 1
    assert right[True] >= 0.9 * sum(right.values())


def test_op6_against_the_rules(spark, sf):
    found = {r.page_id: r for r in queries.op6_url_filter(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    scores = {r.page_id: r.spam_score for r in url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(found) == len(pages)
    for p in pages:
        host, path, rule, verdict = brute_rule(p.url)
        r = found[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if scores[p.page_id] >= 0.55 else "allow"))


def test_op7_against_brute_force(spark, sf):
    found = queries.op7_suffix_dedup(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found), key=str) == brute_bytes(texts_of(spark, sf))


def test_op8_against_brute_force(spark, sf):
    found = queries.op8_near_duplicates(spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute_components(texts_of(spark, sf), 3, 85)


def test_op10_against_brute_force(spark, sf):
    found = queries.op10_repeated_phrases(spark, sf).collect()
    want = [(i, n, removed, hashlib.sha256(kept.encode()).hexdigest()) for i, n, removed, kept in brute_words(texts_of(spark, sf))]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == want


@pytest.mark.parametrize("name", ["op4_packing", "op9_chat_format"])
def test_whole_table(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    if name.startswith("op9"):
        ids = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
        assert found.count() == ids and found.where("conv_id = -7 and n_turns = 2 and loss_chars = 21").count() == 1
    else:
        assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.where("text is not null and n_chars <> length(text)").count() == 0
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.6 * kept[0]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_stages_against_brute_force(spark, sf):
    """Each stage on nulls, empty, long and repeated rows, repeated and missing ids, beside a plain version of it."""
    rng = random.Random(8)
    words = [rng.choice(["the", "thing", "of", "that", "there", "éa"]) + str(rng.randint(0, 30)) for _ in range(400)]
    passage = " ".join(words[:60])
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()
    texts = [None, "", " \n", passage, passage, passage + " end", "long " * 20_000 + "tail", item.text, "own words here " + " ".join(words[100:180]) + " " + item.text] + [" ".join(rng.choices(words, k=rng.randint(1, 80))) + (" " + passage[: rng.randint(100, 350)] if i % 3 else "") for i in range(25)]
    ids = [None, 1, 2, 3, 3, 4, 5, 6, 7, *range(10, 35)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, h long"
    all_rows = [(i, t, "en" if k % 2 else None, "s", None if t is None else len(t), 1, "x", 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(all_rows, schema)
    given = [(k, t) for k, (_, t) in enumerate(sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or "")))]
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or ""))
    said = corpus_pipeline.identify_language(spark, docs, sf)
    assert said.columns == corpus_pipeline.COLUMNS and not said.where("text is null or trim(text) = ''").count()
    near = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    heads = Counter(order[k] for k, _, component, kept in brute_components(given, 5, 80) if kept)
    assert Counter((r.doc_id, r.text) for r in near) == heads
    cut = corpus_pipeline.drop_repeated_strings(spark, docs, sf).collect()
    sizes = {k: n - removed for k, n, removed, _ in brute_bytes(given)}
    left = Counter(i for k, (i, t) in enumerate(order) if sizes[k] == len((t or "").encode()) or sizes[k] > 8)
    assert left - Counter(r.doc_id for r in cut) <= Counter() and all(r.text is None or "�" not in r.text for r in cut)
    assert {(r.doc_id, r.text) for r in cut if r.text is None or len(r.text) < 100} >= {(None, None), (1, "")}
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf).collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = Counter(i for i, *_, bad in brute_contaminated([(i, t) for i, t in zip(ids, texts, strict=True) if i != 5], bench) if bad)
    assert Counter(r.doc_id for r in clean) == Counter(ids) - dirty and dirty[6] == dirty[7] == 1
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert packed.where("start = 0").count() == len(ids) and packed.agg(F.max("offset")).first()[0] < 4096
