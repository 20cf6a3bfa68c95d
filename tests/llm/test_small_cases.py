"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, components, decontaminate, html_extract, langid, near_dup, packing, phrases, suffix_dedup, topk, url_filter

DOCS = "doc_id long, text string, word string, score double, rank int, row long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1.0, 2, 3) for i, t in rows], DOCS)


# --- 1 --------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def brute_top(rows, k, divisor):
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % divisor == 0}):
        mine = [v for i, v in ok if i == q]
        best = {}
        for i, v in ok:
            for m in mine:
                if i != q and len(v) == len(m):
                    best[i] = max(best.get(i, -(2**70)), max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(m, v)))))
        out += [(q, n, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.5, -0.25, 0.125, 0.1]) for _ in range(4)]) for i in range(300)]
    rows += [(5, [0.5] * 4), (7, None), (8, [0.1, None, 0.2, 0.3]), (9, [float("nan")] * 4), (11, [float("inf")] * 4), (None, [0.1] * 4), (100, [0.5] * 3), (1000, []), rows[20], (2000, [3e37] * 4)]
    q = topk.quantise(vectors(spark, rows))
    found = topk.top_k(q.where("vec_id % 50 = 0"), q, k=7, shard_rows=32, query_rows=3)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 7, 50)
    topk.CELL_BYTES, before = 8 * 4 * 5, topk.CELL_BYTES  # five vectors of four to a matrix
    again = topk.top_k(q.where("vec_id % 50 = 0").withColumn("rank", F.lit("x")), q.withColumn("query_id", F.lit("y")), k=7)
    topk.CELL_BYTES = before
    assert sorted(map(tuple, again.collect())) == brute_top(rows, 7, 50)
    assert topk.top_k(q.where("false"), q).count() == 0
    assert topk.top_k(q, q.where("false")).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_html(spark):
    page = "<html><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First   text, with words.<p>Second\n<b>bold</b> text.<script>var x='</p>';</script></article><div class='ad'>Buy this</div><footer>&copy; 2020 site</footer></body></html>"
    long = "<article>" + "<p>Many words stand here, in order.</p>" * 5000 + "</article>"
    rows = [(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", "<p", 1), (4, "x", long, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(((r.page_id or -1, r.url, r.text) for r in html_extract.extract(df).collect()), key=str)
    want = "Title & more\nFirst text, with words.\nSecond bold text."
    assert found == sorted([(1, "u", want), (1, "u", want), (2, None, ""), (3, "v", ""), (-1, "w", ""), (4, "x", "\n".join(["Many words stand here, in order."] * 5000))], key=str)
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_attributes_and_open_head():
    told = lambda page: " ".join(x.strip() for v in html_extract.parse(page) for x in v.items if isinstance(x, str) and x.strip())
    for kept in ('href="/hidden-gems"', 'title="the hidden city"', 'data-hidden="false"', "alt='x hidden'", "href=/a/hidden", 'data-style="display:none"', 'data-aria-hidden="true"'):
        assert told(f"<body><p {kept}>some text</p>") == "some text", kept
    for lost in ("hidden", 'class="a" hidden', "HIDDEN=''", 'aria-hidden = "true"', "style='display: none'", "style=display:none"):
        assert told(f"<body><p {lost}>some text</p><p>rest") == "rest", lost
    node = html_extract.parse("<div title='class=ad' CLASS=content>x</div>")[1]
    assert node.good and not node.bad
    for page in ("<html><head><title>t</title><body><article>text</article>", "<html><head><meta charset=x><title>t</title><article>text</article>", "<head><style>a</style>text</head>", "<head><template><p>no</p></template></head><body>text"):
        assert told(page) == "text", page


def test_html_on_generated_pages():
    model, rng, scores = html_extract.train(), random.Random(123), []
    for _ in range(80):
        page, _ = html_extract.training_page(rng)
        told = " ".join(x for v in html_extract.parse(page) for x in v.items if isinstance(x, str) and "\x01" in x).replace("\x01", "").split()
        found = html_extract.main_text(page.replace("\x01", ""), model).split()
        scores.append(2 * sum((Counter(told) & Counter(found)).values()) / max(1, len(told) + len(found)))
    assert np.mean(scores) > 0.93


def test_nothing_below_a_dropped_element_is_kept():
    nodes = html_extract.parse("<div><p>a</p><div><p>b</p></div></div><div><p>c</p></div>")
    rng = np.random.default_rng(0)
    html_extract.features(nodes)
    for _ in range(50):
        kept = html_extract.choose(nodes, rng.normal(size=len(nodes)))
        assert all(kept[v.parent] for v, k in zip(nodes, kept, strict=True) if k and v.parent >= 0)


# --- 3 --------------------------------------------------------------------------------------------------------------


def brute_contaminated(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, b in items:
            v = words(b)
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item) if item is not None else "null")
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = ["the", "Of", "a", "École", "école", "x1", "K", "ﬁn", "İz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 13, 14, 30]))) for i in range(3, 12)] + [(20, None), (21, "..."), (22, "rare words"), (22, "rare words"), (None, "only null")]
    rows = [(i, text(20) + " " + rng.choice(items[:9])[1].upper() + "," + text(5) if i % 3 else text(rng.randint(0, 60))) for i in range(30)] + [(5, None), (5, ""), (5, "..."), (None, "Rare-WORDS!"), (7, "only null"), (8, "rare words " * 3000)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, window string")
    found = decontaminate.decontaminate(docs(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found), key=str) == brute_contaminated(rows, items)
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0
    assert not decontaminate.decontaminate(docs(spark, rows), bench.where("false")).where("n_hit > 0").count()
    decontaminate.BROADCAST_ROWS, before = 1, decontaminate.BROADCAST_ROWS
    again = decontaminate.decontaminate(docs(spark, rows).coalesce(1), bench).collect()
    decontaminate.BROADCAST_ROWS = before
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in again) == sorted((str(r.doc_id), r.n_words, r.n_hit) for r in found)
    bad = Counter((r.doc_id, r.n_words) for r in found if not r.contaminated)
    kept = decontaminate.clean(docs(spark, rows), bench, ("word", "rank")).collect()
    assert Counter(r.doc_id for r in kept) == Counter(i for i, _ in bad.elements()) and kept[0].asDict().keys() == {"doc_id", "text", "word", "rank"}


def test_decontamination_folds_words_without_context(spark):
    items = [(1, "Ο Α.Σ. Β"), (2, "ΟΔΟΣ.ΑΒ ΓΔ"), (3, "İΣ' end OF it")]
    rows = [(1, "x Ο Α.Σ. Β y"), (2, "ΟΔΟΣ.ΑΒ ΓΔ"), (3, "İΣ' End of IT"), (4, "ο α.σ. β"), (5, "ΟΔΟΣ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found), key=str) == brute_contaminated(rows, items)
    assert sorted((r.doc_id, r.n_hit) for r in found) == [(1, 4), (2, 3), (3, 4), (4, 0), (5, 0)]


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    own = Tokenizer.from_file(path)
    odd = "İstanbul áb ｈｅ <|endoftext|> it's THE'S 12ab3 ..., a.,b \x1c\x85y (naïve). ǆ ﬁ. ΑΣ Σ ẞ"
    rows = [(1, "Hello, world. Hello!"), (1, "Hello, world. Hello!"), (2, None), (3, ""), (4, odd), (6, "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>"), (7, "汉 <|endoftext|>汉"), (8, "<|endoftext|> " * 5000), (None, "x"), (5, "many words here. " * 4000)] + [(10 + i, "thing of that " * i) for i in range(60)]
    found = packing.pack_documents(docs(spark, rows), path).collect()
    want = Counter()
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            piece = ids[s : s + 4096]
            want[(i, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    by: dict = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(by) == list(range(len(by)))
    assert packing.pack_documents(docs(spark, []), path).count() == 0
    clash = docs(spark, rows[:9]).withColumn("start", F.lit("x")).withColumn("length", F.lit(None).cast("int"))
    assert packing.pack_documents(clash, path).agg(F.sum("length")).first()[0] == sum(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows[:9])


def test_patterns_hold_the_demand():
    rng = random.Random(2)
    for _ in range(10):
        demand = {s: rng.randint(1, 50) for s in rng.sample(range(1, 65), rng.randint(1, 40))}
        held: Counter = Counter()
        used = 0
        for copies, items in packing.patterns_for(demand, 64):
            assert sum(s * n for s, n in items.items()) <= 64
            used += copies
            for s, n in items.items():
                held[s] += copies * n
        assert held == demand
        room: list[int] = []  # first fit, the longest first
        for s in sorted((s for s, n in demand.items() for _ in range(n)), reverse=True):
            i = next((i for i, r in enumerate(room) if r >= s), None)
            if i is None:
                room.append(64 - s)
            else:
                room[i] -= s
        assert used <= 1.02 * len(room) + 1


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_language_id(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    models = langid.train(d, ~held)
    p = langid.predict(d.where(held), models, keep=("lang",))
    assert p.where("lang = lang_pred").count() >= 0.9 * p.count()
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "é" * 10), (None, "the of and that"), (5, "the and of " * 30_000)]
    found = {r.doc_id: r for r in langid.predict(docs(spark, rows), models).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[4].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in found.values()) and found[5].lang_pred == "en"
    assert langid.predict(docs(spark, []), models).count() == 0
    clash = docs(spark, rows).withColumn("lang_pred", F.lit("zz")).withColumn("size", F.lit(1))
    assert sorted(map(str, langid.predict(clash, models).collect())) == sorted(map(str, langid.predict(docs(spark, rows), models).collect()))
    twin = models.entropy(["the and of the", "the and of the"])[0]
    assert (twin[0] == twin[1]).all() and models.judge(["the and of"] * 2)[0] == models.judge(["the and of"])[0]
    none = langid.train(d.where("false"), ~held)
    assert {r.lang_pred for r in langid.predict(docs(spark, rows), none).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    text = "abracadabra abra cadabra " * 3
    codes, _, _ = langid.symbols([text])
    grams, counts = np.unique(codes[np.arange(len(codes) - 4)[:, None] + np.arange(5)], axis=0, return_counts=True)
    alphabet = len(set(codes.tolist()))
    level = langid._Levels(grams, counts, alphabet)
    keys, p = level.grams[0]
    assert p.sum() <= 1.0 + 1e-9 and (p > 0).all()


def test_language_models_of_all_grams(spark):
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "".join(rng.choice(letters) for _ in range(40_000)), "xx") for i in range(4)] + [(9, "abra cadabra", "yy")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = langid.gram_counts(labelled)
    found = {(r.lang, r.gram): r.n for r in counts.collect()}
    want = Counter()
    for _, text, lang in rows:
        padded = "    " + text
        want.update((lang, padded[i : i + 5]) for i in range(len(padded) - 4))
    assert found == dict(want) and len(found) > 150_000
    models = langid.estimate(counts)
    for j, lang in enumerate(models.langs):
        own = [(g, n) for (x, g), n in want.items() if x == lang]
        grams = np.frombuffer("".join(g for g, _ in own).encode("utf-32-le"), "<u4").reshape(-1, 5)
        level = langid._Levels(grams, np.array([n for _, n in own]), (27 + 1) * 8 if " " in {g[-1] for _, g in want} else (26 + 1) * 8)
        for n in range(1, 6):
            keys, p = level.grams[n - 1]
            values, hit = models._look(f"grams-{n}", keys)
            assert hit.all() and np.allclose(values[:, j], np.log(p), atol=1e-4)
    texts = ["abra cadabra", "qqqéé zz", "a"]
    whole = models.entropy(texts)[0]
    resident, langid.RESIDENT = langid.RESIDENT, 60_000
    langid._loaded.clear(), langid._slots.clear()
    assert models._table("grams-5")[2] and np.allclose(models.entropy(texts)[0], whole)
    langid.RESIDENT = resident


def test_language_of_few_rows_is_learned(spark):
    odd = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 2]
    rng, words = random.Random(3), {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["kveld", "morgen", "natt", "dager"]}
    say = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(i, say("aa"), "aa") for i in range(2000, 2300)] + [(i, say("bb"), "bb") for i in odd[:4]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(d, F.lit(True))
    found = langid.predict(d, models, keep=("lang",))
    assert models.langs == ["aa", "bb"] and not found.where("lang <> lang_pred or rejected").count()
    assert np.isfinite(models.limits["bb"])
    held = langid.held_out({"aa": 300, "bb": 4})
    assert 0 < d.where(held).count() <= 100 and not d.where(held).where("lang = 'bb'").count()


# --- 6 --------------------------------------------------------------------------------------------------------------


def brute_rule(url):
    """Host, path, rule and the rule's verdict, by the contract's words."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_filter(spark):
    cases = {
        "https://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://example.com/de/": ("example.com", "/de/", "com/", "allow"),
        "http://notexample.com": ("notexample.com", "", None, None),
        "http://x.net/fr/1": ("x.net", "/fr/1", "net/fr/", "block"),
        "https://gambling-hub.org/en/4": ("gambling-hub.org", "/en/4", None, "block"),
        "https://megawin777.org/": ("megawin777.org", "/", None, "block"),
        "https://www.city-library.org/en/4": ("www.city-library.org", "/en/4", None, "allow"),
        "https://spamalot-musical.org/": ("spamalot-musical.org", "/", None, "allow"),
        "no url": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "http://x.net/es/" + "long/" * 20_000: ("x.net", "/es/" + "long/" * 20_000, "net/es/", "block"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "h"), (None, "http://x.net/es/", "h")], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (url, (host, path, rule, verdict)) in enumerate(cases.items()):
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule) == brute_rule(url)[:3]
        assert found[i].verdict == verdict if verdict else found[i].verdict in ("allow", "block")
    assert url_filter.judge(df).count() == len(cases) + 2
    assert url_filter.judge(df.where("false")).count() == 0


def test_url_model_on_held_out_urls(spark):
    blocked, allowed, n = url_filter.held_out_accuracy(spark)
    assert n > 200 and blocked > 0.65 and allowed > 0.95
    assert not set(url_filter.BAD_WORDS) & set(url_filter.GOOD_WORDS)


# --- 7 and 10 -------------------------------------------------------------------------------------------------------


def brute_bytes(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + 200] for _, b in data for j in range(len(b) - 199))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        out.append((i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows):
    words = sorted(((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.fixture(params=[4096, 2])
def heavy(request):
    before = suffix_dedup.GROUP, phrases.GROUP
    suffix_dedup.GROUP = phrases.GROUP = request.param
    yield
    suffix_dedup.GROUP, phrases.GROUP = before


def twins(size: int = 1024) -> tuple[str, str]:
    """Two words that any polynomial hash modulo a power of two takes for one."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_equal_hashes_are_not_equal_texts(spark):
    x, y = twins()
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}")]
    assert [r.n_removed for r in phrases.remove_phrases(docs(spark, rows)).collect()] == [0, 0]
    found = near_dup.near_duplicates(docs(spark, [(1, f"{x} one two"), (2, f"{y} one two")]), 3, 85).collect()
    assert all(r.kept for r in found)
    rows = [(1, x), (2, y), (3, x[:300] + "c" + y[:300])]
    found = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found), key=str) == brute_bytes(rows)


def test_windows_by_common_prefixes():
    rng = random.Random(9)
    for turn in range(300):
        window = rng.choice([4, 6, 9])
        at = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, window))), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, window)))) for _ in range(rng.randint(2, 12))]
        at.sort(key=lambda x: x[1])
        prefixes = [0] + [suffix_dedup.shared_prefix(a[1], b[1]) for a, b in zip(at, at[1:])]
        found = {(i, x) for i, low, high in suffix_dedup.repeated_windows(prefixes, [left[::-1] for left, _ in at], window) for x in range(low, high + 1)}
        have = [{x: left[len(left) - x :] + right[: window - x] for x in range(len(left) + 1) if 0 <= window - x <= len(right)} for left, right in at]
        want = {(i, x) for i, own in enumerate(have) for x, w in own.items() if any(have[j].get(x) == w for j in range(len(at)) if j != i)}
        assert found == want, turn


def test_suffix_dedup(spark, heavy):
    rng = random.Random(3)
    p = "".join(rng.choice("abcdefgh é") for _ in range(700))
    noise = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 200)))
    rows = [(1, p[:500]), (2, "x" * 350), (3, "y" * 200), (4, "y" * 201), (5, None), (6, ""), (7, p[100:420] + "Q" + p[421:]), (7, p[100:420] + "Q" + p[421:]), (7, "other " + p[300:]), (None, p[200:600]), (8, "ab" * 4000)]
    rows += [(100 + i, noise() + p[i % 5 * 10 :][: rng.randint(150, 400)] + noise()) for i in range(30)]
    rows += [(200 + i, noise() + p[:150] + noise() + p[50 : 50 + rng.randint(120, 230)] + noise()) for i in range(20)]
    found = suffix_dedup.remove_repeats(docs(spark, rows), keep=("word",)).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found), key=str) == brute_bytes(rows)
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(docs(spark, rows[9:10])).first().spans == []


def test_merge_of_front_coded_runs():
    rng = random.Random(5)
    for _ in range(30):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 7))]
        merged = list(suffix_dedup.merge([suffix_dedup.decode(*suffix_dedup.front_code(r)) for r in runs]))
        strings = [s for _, s, _ in merged]
        assert strings == sorted(s for r in runs for s in r)
        for (_, a, _), (n, b, _) in zip(merged, merged[1:]):
            assert n == suffix_dedup.shared_prefix(a, b)


def test_phrases(spark, heavy):
    rng = random.Random(3)
    w = [rng.choice(["a", "bé", "c", "d\x1ce", "Ff", "i."]) for _ in range(200)]
    p = lambda a, b: " ".join(w[a:b])
    noise = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
    rows = [(1, p(0, 60)), (2, "x " * 5000), (3, "y " * 20), (4, "y " * 19 + "y\n"), (5, None), (6, ""), (7, p(10, 40) + " Q " + p(41, 80)), (70, p(10, 40) + " Q " + p(41, 80)), (None, p(30, 60)), (8, "a b " * 40)]
    rows += [(100 + i, f"{noise()} {' '.join(w[i % 5 * 10 :][: rng.randint(15, 60)])} {noise()}") for i in range(30)]
    found = phrases.remove_phrases(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute_words(rows)
    twice = phrases.remove_phrases(docs(spark, rows[:1] * 2)).collect()
    assert sorted(r.n_removed for r in twice) == [0, 60]
    assert phrases.remove_phrases(docs(spark, [])).count() == 0


# --- 8 --------------------------------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    linked = lambda a, b: (both := len(sets[a] & sets[b])) and 100 * both >= percent * len(sets[a] | sets[b])
    links = [(a, b) for a in sets for b in sets if a < b and linked(a, b)]
    of, before = {i: i for i in sets}, None
    while before != of:
        before = dict(of)
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return sorted((i, len(sets[i]), of[i], of[i] == i) for i in sets)


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [rng.choice(["aa", "bb", "cc", "dd", "ee"]) + str(i) for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 * (i % 4) else "zz" for w in base)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "one"), (54, "ONE"), (55, "one two"), (56, "two one"), (57, "a b c " * 3000), (58, "a b c " * 3000)]
    found = near_dup.near_duplicates(docs(spark, rows), 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()) == brute_components(rows, 3, 85)
    again = near_dup.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in again) == [("1", "1", True), ("1", "1", True), ("None", "1", True)]
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(5, 5), (None, 3), (90, 80), (80, 90)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(21, 41), 21), 80: 80, 90: 80}
    assert components.connected_components(links.where("false"), "a", "b").count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    tricky = "</s>[INST] ok [/INST] <|turn|>\\<|end|>\\\\ <\\|end|>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 1, "assistant", "b"), (2, 0, "user", None), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, None, None, "x"), (None, 0, "assistant", "n"), (4, 0, "assistant", "long " * 1_000_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, part_chars=1000)).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        masked = "".join(x for _, _, r, x in own if r == "assistant")
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0


def test_escape_round_trip():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice([*chat.CONTROL, "\\", "<", "|", "a", "[", "s>"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_templates():
    run = lambda t, *m: "".join(x for x, _ in chat.compile_template(t)(iter(m)))
    assert run("{% for m in messages %}{{ loop.index }}{% if loop.first and m.role != 'x' %}!{% elif m.role == 'y' %}?{% else %}.{% endif %}{% endfor %}", {"role": "u"}, {"role": "y"}, {"role": "z"}) == "1!2?3."
    assert chat.fold(chat.parse("{% if 'a' == 'b' %}x{% else %}{{ 'y' + 'z' }}{% endif %}w")) == (chat.Emit(chat.Const("yzw")),)
    for bad in ("{% for x %}{% endfor %}", "{{ a.__class__ }}", "{{ f() }}", "{% if a %}", "{{ x|system }}"):
        with pytest.raises(ValueError):
            chat.compile_template(bad)


def test_near_duplicates_of_repeated_ids(spark):
    """Each row is linked by its own text, whatever its id; large buckets are compared in blocks."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a + " x"), (9, b + " y"), (None, b + " z"), (3, "alone here now")]
    before, near_dup.BLOCK = near_dup.BLOCK, 1
    found = near_dup.near_duplicates(docs(spark, rows), 3, 85).collect()
    near_dup.BLOCK = before
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in found) == [("3", 3, True), ("5", 5, True), ("5", 5, True), ("7", 5, False), ("9", 5, False), ("None", 5, True)]


def test_recall_around_the_threshold(spark):
    """Pairs of texts whose similarity lies between 0.8 and 0.9: those at 0.85 or more are found, the others are not linked."""
    rng, rows, want = random.Random(12), [], {}
    for i in range(1500):
        words = [f"w{i}x{j}" for j in range(120)]
        other = words[:]
        for j in rng.sample(range(0, 120, 3), rng.randint(1, 7)):
            other[j] = f"v{i}y{j}"
        sets = [{tuple(w[j : j + 3]) for j in range(118)} for w in (words, other)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want[2 * i + 1] = 2 * i if 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]) else 2 * i + 1
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows), 3, 85).collect() if r.doc_id % 2}
    assert found == want and 200 < sum(i != c for i, c in want.items()) < 1400


@pytest.mark.parametrize("unit", ['<a href="x" ', "<b>", "</i>", "<p>", "<title>", "<a b='x ", "<svg><g>", "<!-- ", '<a "=<b>', "</title<title>", "&amp;&lt;", "<div class='a b'>x", "<td><tr>x"])
def test_html_of_hostile_pages(unit):
    """Work grows with the length of a page, whatever it consists of (a quadratic parser would take minutes here)."""
    page = "<b>" * 20_000 + unit * (600_000 // len(unit))
    began = time.time()
    nodes = html_extract.parse(page)
    html_extract.features(nodes)
    assert time.time() - began < 30


def test_html_drops_no_tails():
    told = lambda page: " ".join(x.strip() for v in html_extract.parse(page) for x in v.items if isinstance(x, str) and x.strip())
    for tag in ("title", "noscript", "iframe", "textarea", "script", "style"):
        assert told(f"<p>one</p><{tag}>x<p>two</p><p>three") == "one two three", tag
    assert told("<p>a < b and 3 > 2</p>") == "a < b and 3 > 2"
    assert told('<p title="a > b">text</p>') == "text" and told("<p title=it's>text</p><p>more</p>") == "text more"
    assert told("<script>if (a < b) '</p>'</script >text") == "text" and told("text <b") == "text" and told("one <!-- two") == "one"


#: Pages written by hand, not by the generator, with the text a reader would copy from them.
PAGES = [
    ("""<html><head><title>Tides - Coast Almanac</title></head><body><div id="top"><a href="/">Home</a> | <a href="/log">Log</a></div>
     <div class="content"><h1>Why tides turn</h1><p>The moon pulls the sea towards it, and the sea follows a little late.</p><p>Twice a day the water rises, rests, and falls again along most coasts.</p></div>
     <div class="sidebar"><h3>Related</h3><ul><li><a href="/a">Moon phases</a></li><li><a href="/b">Harbours</a></li></ul></div><footer>Copyright 2019 Coast Almanac</footer></body></html>""",
     "Why tides turn\nThe moon pulls the sea towards it, and the sea follows a little late.\nTwice a day the water rises, rests, and falls again along most coasts."),
    ("""<!doctype html><body><header class=masthead><h2>The Baker</h2><nav><ul><li><a href=/r>Recipes</a><li><a href=/c>Contact</a></ul></nav></header>
     <main><article><h1>Rye bread</h1><p>Mix flour, water and salt. Leave the dough for a night.</p><ul><li>500 g rye flour</li><li>400 g water, lukewarm</li></ul><p>Bake it hot for an hour, then let it cool on a rack.</p></article></main>
     <section class="comments"><h3>2 comments</h3><ol><li><p>Great loaf, thank you!</p></li><li><p>Mine was too dry.</p></li></ol></section></body>""",
     "Rye bread\nMix flour, water and salt. Leave the dough for a night.\n500 g rye flour\n400 g water, lukewarm\nBake it hot for an hour, then let it cool on a rack."),
    ("""<html><body><div class="cookie-notice"><p>We use cookies to improve this site. Accept them or leave.</p><button>OK</button></div><nav class="breadcrumbs"><a href="/">Start</a> <a href="/h">History</a></nav>
     <article class="post"><h2>The old bridge</h2><p>It was built in 1742 &mdash; and rebuilt twice since, once after a flood.</p><blockquote><p>No stone of it is where it was, wrote the mayor.</p></blockquote><p>Today it carries the market road, and nothing heavier.</p></article>
     <aside><p>Subscribe to our newsletter for more stories like this one.</p></aside></body></html>""",
     "The old bridge\nIt was built in 1742 — and rebuilt twice since, once after a flood.\nNo stone of it is where it was, wrote the mayor.\nToday it carries the market road, and nothing heavier."),
    ("""<body><div class="wrapper"><div class="ad banner">Buy two lamps, get one free, today only.</div><div class="entry-content"><h1>Owls at night</h1>
     <p>Owls hear a mouse under snow. <a href="/ears">Their ears</a> sit at different heights, which tells them how high a sound is.</p><p>They fly without a sound because their feathers break the air.</p></div>
     <form action="/search"><label>Search</label><input name=q><p>Find more on birds here</p></form><div class="footer">All rights reserved</div></div></body>""",
     "Owls at night\nOwls hear a mouse under snow. Their ears sit at different heights, which tells them how high a sound is.\nThey fly without a sound because their feathers break the air."),
    ("<html><body><nav><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li><li><a href='/3'>Three</a></li></ul></nav><footer>Imprint, privacy, contact</footer></body></html>", ""),
]


def test_html_on_pages_written_by_hand():
    model = html_extract.train()
    found = [html_extract.main_text(page, model) for page, _ in PAGES]
    assert found == [text for _, text in PAGES]


# --- whole results beside plain versions ----------------------------------------------------------------------------


def test_language_id_beside_plain_kneser_ney(spark):
    """Predictions and cross-entropies of the query's operator, from a plain model in dictionaries."""
    rng = random.Random(21)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet", "sit"], "bb": ["kveld", "morgen", "natt", "dolor", "år"], "cc": ["ñandú", "sit", "amor", "rey"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 12))), lang) for i, lang in enumerate(rng.choices(list(words), k=90))]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(labelled, F.lit(True))
    counted = {r.doc_id for r in labelled.where(~langid.held_out(Counter(r[2] for r in rows))).collect()}
    order, counts = langid.ORDER, {n: Counter() for n in range(1, langid.ORDER + 1)}
    for i, text, lang in rows:
        if i in counted:
            codes = langid.symbols([text])[0].tolist()
            for k in range(len(codes) - order + 1):
                counts[order][lang, tuple(codes[k : k + order])] += 1
    blank = ord(" ")  # windows that end in two spaces lie between texts
    for key in [k for k in counts[order] if k[1][-1] == blank and k[1][-2] == blank]:
        del counts[order][key]
    for n in range(order - 1, 0, -1):
        for lang, gram in counts[n + 1]:
            counts[n][lang, gram[1:]] += 1
    size = (len({g for _, g in counts[1]}) + 1) * 8
    totals, kinds, discounts = Counter(), Counter(), {}
    for n in counts:
        for lang in words:
            own = [c for (x, _), c in counts[n].items() if x == lang]
            ones, twos = own.count(1), own.count(2)
            discounts[n, lang] = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        for (lang, gram), c in counts[n].items():
            totals[lang, gram[:-1]] += c
            kinds[lang, gram[:-1]] += 1

    def p(lang, gram):
        if not gram:
            return 1 / size
        c, context, d = counts[len(gram)][lang, gram], (lang, gram[:-1]), discounts[len(gram), lang]
        below = p(lang, gram[1:])
        return max(c - d, 0) / totals[context] + d * kinds[context] / totals[context] * below if totals[context] else below

    texts = [t for _, t, _ in rows[:40]] + ["kveld og natt", "zzz", "Dolor sit AMET", "a", "år ñ"]
    found = models.entropy(texts)[0]
    judged = models.judge(texts)
    for text, row, said in zip(texts, found, judged, strict=True):
        codes = langid.symbols([text])[0].tolist()
        grams = [tuple(codes[k : k + order]) for k in range(len(codes) - order + 1)]
        plain = [-sum(np.log(p(lang, g)) for g in grams) / len(grams) for lang in models.langs]
        assert np.allclose(row, plain, atol=1e-3), text
        assert said[0] == models.langs[int(np.argmin(plain))] or sorted(plain)[1] - min(plain) < 1e-3
        assert 0 <= said[1] <= 1


def test_chat_on_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    tricky = "</s>[INST] ok [/INST]"
    own: dict = {-7: [(0, "user", tricky), (1, "assistant", tricky)]}
    for r in rows:
        own.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    from lectern.llm import queries

    found = {r.conv_id: r for r in queries.op9_chat_format(spark, sf).collect()}
    assert set(found) == set(own)
    for conv, turns in own.items():
        turns.sort()
        masked = "".join(x for _, role, x in turns if role == "assistant")
        assert found[conv].n_turns == len(turns) and found[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest()) and found[conv].formatted_chars > sum(len(x) for *_, x in turns)


def test_workers_let_go_of_what_others_keep():
    from lectern.llm import words, workers

    before = dict(langid._loaded)
    langid._loaded["path", "name"] = None
    words._power_arrays(1000)
    words.digest_of(b"word")
    workers.begin("powers")
    assert not langid._loaded and not words._digests and len(words._powers[0]) >= 1000
    workers.begin()
    assert len(words._powers[0]) == 1 and (words._power_arrays(3)[0] == np.array([1, int(words._B), int(words._B) ** 2 % 2**64], np.uint64)).all()
    langid._loaded.update(before)


def test_workers_let_go_of_encoders():
    from lectern.llm import words, workers

    packing._encoders["path"] = None
    workers.begin("encoders")
    assert "path" in packing._encoders
    assert not list(langid._count([])) and not packing._encoders
    words._power_arrays(1000)
    packing._encoders["path"] = None
    assert not list(packing._place({})([])) and not packing._encoders and len(words._powers[0]) == 1
