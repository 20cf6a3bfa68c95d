"""Common lines, spelling variants and hard negatives on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns, beside plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives, lines, spelling
from lectern.operators import skew
from lectern.session import materialize

DOCS = "doc_id long, text string, word string, key string, place int, row long, n long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", "k", 1, 2, 3) for i, t in rows], DOCS)


def brute_lines(rows, least):
    key = lambda line: line.strip(lines.WHITE).translate(FOLD)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) and seen[key(x)] >= least)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_common_lines(spark, ids):
    rng = random.Random(3)
    some = ["Share this", " share THIS\t", "Été", "éTÉ", "ÉTÉ", "", "  ", "a\x0bb", "\x0c Menu \r", "menu", " menu", "K", "k", "own line", "x" * 300]
    texts = [None, "", "\n", "Menu", "only\nonly\nonly", "long line " * 5_000 + "\nmenu\n", "menu\n" * 20_000 + "end"]
    texts += ["\n".join(rng.choice(some) + (str(rng.randint(0, 9)) if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 12))) for _ in range(80)]
    rows = [(i if ids == "unique" else rng.choice([None, 1, 2, 3, 40]), t) for i, t in enumerate(texts)]
    for least in (1, 3, 10, 40, 1000):
        found = lines.drop_common_lines(docs(spark, rows), least).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found), key=str) == brute_lines(rows, least), least
    assert lines.drop_common_lines(docs(spark, rows), 3, keep=("key",)).where("key = 'k'").count() == len(rows)
    assert lines.drop_common_lines(docs(spark, []), 3).count() == 0


def test_a_line_counts_once_a_document(spark):
    rows = [(i, "here\nhere\nhere") for i in range(9)]
    assert not lines.drop_common_lines(docs(spark, rows)).where("n_dropped > 0").count()
    found = lines.drop_common_lines(docs(spark, [*rows, (9, "HERE\nown")])).collect()
    assert {(r.n_dropped, r.kept) for r in found} == {(3, ""), (1, "own")}


def test_lines_are_counted_without_python(spark, sf):
    found = lines.drop_common_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions|CartesianProduct|NestedLoop", plan)


def test_joins_of_heavy_keys(spark):
    rows = spark.createDataFrame([(None if i % 50 == 0 else f"k{0 if i % 3 else i}", i) for i in range(6000)], "key string, i int")
    counts = materialize(rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("m")), "counts")
    found = skew.join_by_weight(rows, counts, "key", "m")
    assert sorted(map(tuple, found.select("key", "i", "m").collect())) == sorted(map(tuple, rows.join(counts, "key").select("key", "i", "m").collect()))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    assert skew.join_by_weight(rows, counts.where("false"), "key", "m").count() == 0


def brute_words(rows, every, shortest, least):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % every == 0 else low] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def edits(a, b):
    """One insertion, deletion or replacement apart, by looking at each place."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(words, ratio=2):
    near = {w: [v for v in words if edits(v, w)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_spelling_variants(spark, block):
    rng = random.Random(6)
    base = ["ababa", "ababab", "abcdé", "Évolution", "évolution", "aaaaa", "aaaaaa", "color", "colour", "theatre", "ß" * 6, "z" * 5_000]
    words = [rng.choice(base) for _ in range(400)]
    for k, w in enumerate(words):
        if len(w) < 99 and rng.random() < 0.6:
            at = rng.randint(0, len(w) - 1)
            words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÉ") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)] + [(None, None), (50, ""), (51, "12 --"), (1, "Colour, COLOUR; colour"), (None, "color colour"), (52, "theatre " * 20_000)]
    spelling.BLOCK, before = block, spelling.BLOCK
    packed, spelling.PACKED = spelling.PACKED, 64 if block > 3 else 2
    try:
        for every in (5, 97):
            found = spelling.group_variants(docs(spark, rows), every).collect()
            assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found), key=str) == brute_variants(brute_words(rows, every, 5, 3)), every
        short = spelling.group_variants(docs(spark, rows[:10]), 3, shortest=1, least=1).collect()
        assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in short), key=str) == brute_variants(brute_words(rows[:10], 3, 1, 1))
    finally:
        spelling.BLOCK, spelling.PACKED = before, packed
    assert spelling.group_variants(docs(spark, [])).count() == 0
    assert spelling.group_variants(docs(spark, rows[40:43])).count() == 0


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"x{i}", "w5") for i in range(50)] + [("y", "z")]
    df = materialize(spark.createDataFrame(chain, "word string, form string"), "chain")
    found = {r.word: r.root for r in spelling.roots(df).collect()}
    assert found == {w: "z" if w == "y" else "w37" for w, _ in chain} and spelling.roots(df.where("false")).count() == 0


def test_strassen_is_exact():
    rng = np.random.default_rng(5)
    for m, d, n in ((1, 1, 1), (33, 33, 33), (70, 65, 129), (200, 64, 90), (40, 0, 50), (0, 40, 50)):
        for most in (3, 2**20, 2**31, 2**62):
            a, b = rng.integers(-most, most, (m, d)), rng.integers(-most, most, (d, n))
            assert (hard_negatives.strassen(a, b) == a @ b).all()
    a = np.full((40, 40), 2**60)
    assert (hard_negatives.products(a, a) == hard_negatives.LONG).all()


def brute_negatives(rows, anchors, k=5, m=3, low=50, high=95):
    ok = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            e = [max(-(2**63), min(2**63 - 1, math.floor(256 * float(np.float32(x))))) for x in v]
            ok.setdefault(i, []).append((label, e))
    ok = {i: min(x) for i, x in ok.items()}
    by = defaultdict(list)
    for i, (label, e) in ok.items():
        by[len(e)].append((i, label, e))
    out = []
    for a in (i for i in ok if anchors(i)):
        label, e = ok[a]
        scored = sorted(((max(-hard_negatives.LONG, min(hard_negatives.LONG, sum(x * y for x, y in zip(e, f, strict=True)))), i, of) for i, of, f in by[len(e)] if i != a), key=lambda x: (-x[0], x[1]))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            out += [(a, p, n, i, s, t) for n, (t, i, _) in enumerate([x for x in scored if x[2] != label and low * s <= 100 * x[0] <= high * s][:m], 1)]
    return sorted(out)


def test_hard_negatives(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.5, -0.25, 0.125, 0.1]) for _ in range(5)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(260)]
    rows += [(i, [0.3] * 5, 0) for i in range(300, 340)] + [(i, [0.2] * 5, 1) for i in range(340, 360)] + [(i, [0.0] * 5, i % 2) for i in range(400, 460)]
    rows += [(7, [0.5] * 5, 0), (50, [0.1] * 5, 0), (70, None, 1), (71, [0.1, None, 0.2, 0.3, 0.1], 1), (72, [float("nan")] * 5, 1), (73, [float("inf")] * 5, 1), (None, [0.1] * 5, 1), (500, [0.5] * 5, None)]
    rows += [(600, [0.5] * 3, 0), (601, [0.25] * 3, 1), (602, [0.5] * 3, 0), (650, [], 0), (651, [], 1), (652, [], 0), rows[20]]
    df = spark.createDataFrame([(i, v, label, 0, 1, "s") for i, v, label in rows], "vec_id long, embedding array<float>, label int, score int, id int, shard string")
    own = hard_negatives.labelled(df, F.col("label"))
    found = [hard_negatives.mine(own, F.col("vec_id") % 50 == 0), hard_negatives.mine(own, F.col("vec_id") % 50 == 0, shard_rows=16, anchor_rows=2, least_shard_rows=4)]
    want = brute_negatives(rows, lambda i: i % 50 == 0)
    assert want
    for f in found:
        assert sorted(map(tuple, f.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    tile, hard_negatives.TILE = hard_negatives.TILE, 7
    one = [x.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") for x in [hard_negatives.mine(own, F.col("vec_id") % 100 == 0, positives=2, negatives=1, low=10)]]
    assert sorted(map(tuple, one[0].collect())) == brute_negatives(rows, lambda i: i % 100 == 0, 2, 1, 10)
    hard_negatives.TILE = tile
    assert hard_negatives.mine(own, F.lit(False)).count() == 0
    assert hard_negatives.mine(own.where("false"), F.lit(True)).count() == 0
    assert hard_negatives.labelled(df.select("vec_id", "embedding", "label"), F.lit(None)).count() == 0
