"""URL filter: site rules, then a logistic regression on hashed character n-grams of host and path.

Everything on the main path is built-in functions.  The model is fitted once a call on a labelled table of about two thousand
URLs: common words of both kinds in the ways names of sites are made of them, and names that mean nothing; its weights (BUCKETS doubles) enter the plan as one literal array.
"""

from __future__ import annotations

import zlib

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.language import let

BUCKETS = 4096
GRAMS = (3, 4)
ITERATIONS = 20
#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Words of sites that a training corpus does without: gambling, pills, adult, piracy, fraud, forced advertising.
BAD_WORDS = tuple(
    "casino poker slots jackpot roulette gambling betting bets sportsbook lottery bingo blackjack baccarat megawin winbig luckyspin pills viagra cialis "
    "levitra tramadol dietpills weightloss steroids porn xxx sex sexcam escorts nudes hookup camgirls erotic adult milf warez keygen crack torrent nulled "
    "serials malware phishing trojan spyware spam spammer adserver adclick adtrack tracking popunder clickbait linkfarm backlinks seoboost getrich "
    "payday loans quickloan fastcash easycash freemoney moneyback bitcoindouble forexsignals replica fakewatch freegift giveaway prizes surveycash".split()
)
#: Words of ordinary sites.
GOOD_WORDS = tuple(
    "news times daily herald gazette weather science library university college museum history archive recipes cooking kitchen garden travel hotel "
    "guide music radio concert musical theatre cinema health clinic hospital school teacher math physics chemistry biology docs developer software "
    "forum wiki books journal magazine sports football tennis cycling running council government parliament ministry parks photo gallery art design "
    "architecture review community research data language translate grammar dictionary poetry nature ocean river mountain forest climate farming "
    "village family parents children toys pets dogs cats birds horses engine motor cars railway airport harbour island market bakery coffee wine tea "
    "furniture carpentry knitting painting astronomy space planet geology mineral energy solar water bridge tower castle church temple festival "
    "charity volunteer law court justice economy finance insurance bank budget jobs career training workshop lecture thesis essay blog diary letters "
    "maps atlas city town street house office studio factory tools hardware network server cloud security privacy open source code".split()
)
#: How names of sites are made of a word, by label: unwanted ones promise, ordinary ones say who they are; a fifth of either is made
#: in a way of the other, so that no way decides alone.
BAD_NAMES = ("{}", "best-{}", "{}-bonus", "cheap{}", "free-{}", "{}777", "hot{}", "{}4u", "{}-win", "top{}deals")
GOOD_NAMES = ("{}", "the{}", "{}-online", "{}society", "city{}", "national-{}", "{}institute", "{}lab", "{}-group", "my{}")
#: Sounds of names that mean nothing, as many ordinary sites have them.
OPENS, VOWELS, CLOSES = ("b", "d", "f", "gr", "k", "l", "m", "n", "p", "qu", "r", "s", "t", "th", "tr", "v", "wh", "z"), ("a", "e", "i", "o", "u", "ea", "ou", "io"), ("", "n", "r", "s", "l", "nd", "st", "ng", "ck", "th")
BRANDS = 400
ENDINGS = ("example.com", "example.net", "example.org", "site.org")
SUBDOMAINS = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/item-{}", "/a/{}/view")


def brand(i: int) -> str:
    """A name of two or three syllables, made by rule."""
    n, out = 7919 * (i + 1), ""
    for _ in range(2 + i % 2):
        out += OPENS[n % len(OPENS)] + VOWELS[n // 18 % len(VOWELS)] + CLOSES[n // 144 % len(CLOSES)]
        n = n // 5 + 104_729 * (i % 13 + 1)
    return out


def labelled_urls() -> list[tuple[str, int, str]]:
    """The labelled table (url, label, word): every word in five host names and once in a path, names that mean nothing once; what
    stands before and behind a host is dealt in turn to all alike."""
    table, n = [], 0

    def add(label: int, name: str, word: str, in_path: bool = False) -> None:
        nonlocal n
        n += 1
        end = ENDINGS[n // 4 % 4]
        if in_path:
            table.append((f"http://www.{end}/{name}/{31 * n % 997}", label, word))
        else:
            table.append((f"https://{SUBDOMAINS[n % 4]}{name}.{end}{PATHS[n // 3 % 6].format(97 * n % 10_007)}", label, word))

    for label, words, own, other in ((1, BAD_WORDS, BAD_NAMES, GOOD_NAMES), (0, GOOD_WORDS, GOOD_NAMES, BAD_NAMES)):
        for i, word in enumerate(words):
            for j in range(4):
                add(label, own[(3 * i + j) % len(own)].format(word), word)
            add(label, other[i % len(other)].format(word), word)
            add(label, own[(i + 5) % len(own)].format(word), word, in_path=True)
    for i in range(BRANDS):
        add(0, brand(i), brand(i))
    return table


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, mark: str) -> Column:
    """All n-grams of a text, marked; from its characters as an array, so that a long text takes time in proportion."""
    of = lambda c, n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.concat_ws("", F.lit(mark), *(F.get(c, i + k) for k in range(n))))
    return let(F.split(text, ""), lambda c: F.concat(*(of(c, n) for n in GRAMS)))


def buckets_of(host: Column, path: Column) -> Column:
    """Bucket numbers of the distinct n-grams of host and path, each marked as its part's; a number is one sign."""
    parts = (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.regexp_replace(path, "[0-9]+", "0"), F.lit("#")))
    grams = [_grams(text, mark) for mark, text in zip("hp", parts, strict=True)]
    return F.array_distinct(F.transform(F.concat(*grams), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def fit(spark: SparkSession, urls: list[tuple[str, int, str]] | None = None) -> tuple[list[float], float]:
    """Weights by bucket and the intercept, from the labelled table (of bounded size, so one partition)."""
    labelled = spark.createDataFrame([(u, y) for u, y, _ in urls or labelled_urls()], "url string, label int")
    rows = labelled.select("label", buckets_of(host_of(F.col("url")), path_of(F.col("url"))).alias("found")).collect()
    each = len(rows) / (2 * max(1, sum(r.label for r in rows))), len(rows) / (2 * max(1, sum(1 - r.label for r in rows)))
    table = [(float(r.label), each[1 - r.label], Vectors.sparse(BUCKETS, sorted(r.found), [1.0] * len(r.found))) for r in rows]
    learner = LogisticRegression(regParam=0.002, maxIter=ITERATIONS, standardization=False, weightCol="weight")  # both labels weigh the same
    model = learner.fit(spark.createDataFrame(table, ["label", "weight", "features"]).coalesce(1))
    return [float(w) for w in model.coefficients], float(model.intercept)


def held_out_accuracy(spark: SparkSession, by: str = "url") -> tuple[float, float, int]:
    """(share of unwanted URLs blocked, share of ordinary ones allowed, URLs), by a model that didn't learn from these URLs.

    A quarter is held out, by URL (their words stand in other host names) or by `word` (no URL with their words is seen).
    """
    table = [(u, y, w, zlib.crc32((w if by == "word" else u).encode()) % 4 == 2) for u, y, w in labelled_urls()]
    fitted = fit(spark, [x[:3] for x in table if not x[3]])
    held = spark.createDataFrame([(i, u, y) for i, (u, y, _, out) in enumerate(table) if out], "page_id long, url string, label int")
    seen = judge(held, rules=(), fitted=fitted).join(held.select("page_id", "label"), "page_id")
    right = lambda y, v: F.count_if((F.col("label") == y) & (F.col("verdict") == v)) / F.count_if(F.col("label") == y)
    return tuple(seen.agg(right(1, "block"), right(0, "allow"), F.count(F.lit(1))).first())


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (text, verdict), or null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.55, fitted: tuple[list[float], float] | None = None) -> DataFrame:
    """(page_id, host, path, rule, spam_score, verdict) of every row.

    A null url or one without `://` has an empty host and path and so no rule; the model alone judges it.  Whole urls count,
    however long; a score at the threshold blocks, and of rules of one length, which never fit the same url, none is before
    another.  Rows are judged one by one: repeated rows and null ids stay as they are, an empty table gives no rows, and
    columns beside page_id and url are ignored.
    """
    weights, intercept = fitted or fit(pages.sparkSession)
    w = F.lit(weights)
    parts = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    total = F.aggregate(buckets_of(F.col("host"), F.col("path")), F.lit(intercept), lambda s, b: s + F.get(w, b))
    scored = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), (1 / (1 + F.exp(-total))).alias("spam_score"))
    return scored.select("page_id", "host", "path", "rule", "spam_score", F.coalesce("ruled", F.when(F.col("spam_score") >= threshold, "block").otherwise("allow")).alias("verdict"))
