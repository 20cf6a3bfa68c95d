"""The language of a record from its title, abstract and source code.  Latin letters alone never mean English."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function and subject words by which the two Latin-script languages are told apart (fixed values).
ID_MARKERS = (
    "kajian", "kalimat", "ekspresif", "netizen", "komentar", "pada", "dalam", "yang", "dan", "untuk", "dengan", "tidak", "adalah", "penelitian", "ini", "bahasa",
    "siswa", "guru", "data", "hasil", "dari", "atau", "juga", "dapat", "secara", "antara", "karena", "tersebut", "berbagai", "oleh", "jurnal", "pendidikan",
    "sekolah", "kelas", "tindak", "tutur", "makna", "penutur", "penulis", "metode", "analisis", "kesimpulan", "pembelajaran", "mahasiswa", "berdasarkan",
    "merupakan", "sedangkan", "namun", "serta", "salah", "satu", "dua", "tiga", "tahun", "orang", "ke", "di", "apa", "siapa", "bagaimana", "mengapa", "kapan",
    "dimana", "sudah", "belum",
)
EN_MARKERS = (
    "the", "and", "of", "to", "in", "is", "for", "on", "with", "that", "this", "are", "as", "by", "study", "students", "teachers", "language", "english",
    "research", "data", "analysis", "results", "were", "was", "which", "these", "from", "between", "based", "using", "findings", "learners", "education",
    "teaching", "learning", "paper", "article", "however", "therefore", "although", "while", "such", "also", "can", "has", "have", "been", "not", "but", "or",
    "it", "pragmatics", "pragmatic", "syntax", "phonology", "semantics", "morphology", "discourse", "review", "book", "abstracts", "abstract", "development",
    "capacity", "organizational", "toward", "towards", "effect", "effects", "impact", "case", "perspective", "perspectives", "approach", "approaches",
    "exploratory", "instruction", "intervention", "acquisition", "competence", "proficiency", "assessment", "identity", "motivation", "context", "practice",
    "model", "models", "evidence", "framework", "challenges", "opportunities", "role", "a", "an", "at", "into", "through", "during", "after", "before", "under",
    "over",
)
#: Codes of sources by the language they mean here (fixed values).
SOURCE_CODES = {
    "zh": ("zh", "chi", "zho", "zh-cn", "zh-hans", "cmn"),
    "en": ("en", "eng", "en-us", "en-gb"),
    "id": ("id", "ind", "ina"),
    "other": ("ko", "kor", "ja", "jpn", "jv", "jav", "de", "deu", "ger", "fr", "fra", "fre", "es", "spa", "pt", "por", "ru", "rus", "ar", "ara", "th", "tha", "vi", "vie", "tr", "tur", "it", "ita", "nl", "nld"),
}
CJK = "㐀-䶿一-鿿豈-﫿"


def cjk_ratio(c: Column) -> Column:
    """The share of CJK characters among those that are no space."""
    text = F.coalesce(c, F.lit(""))
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    return F.when(cjk > 0, cjk / (F.length(text) - F.regexp_count(text, F.lit(r"[\s　]")))).otherwise(0.0)


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))


def marker_hits(tokens: Column, markers: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, markers))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def detect_language(c: Column, short: bool) -> Column:
    """struct<language, confidence>: scripts first, then marker words; without enough evidence unknown, never a guess."""
    of = lambda language, confidence: F.struct(F.lit(language).alias("language"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"))
    sure = lambda n: F.when(n >= 3, "high").otherwise("medium")
    s = F.coalesce(c, F.lit(""))

    def judge(v: Column) -> Column:
        strong = lambda n: (n >= (1 if short else 2)) | (n / F.greatest(v["n"], F.lit(4)) >= 0.34)
        return (
            F.when(F.trim(v["s"]) == "", of("unknown", "low"))
            .when(v["s"].rlike("[぀-ヿ가-힯]"), of("other", "high"))
            .when(v["ratio"] >= 0.3, of("zh", "high"))
            .when(v["ratio"] > 0.05, of("zh", "medium"))
            .when(v["s"].rlike("[Ѐ-ӿ؀-ۿ]"), of("other", "high"))
            .when((v["id"] > v["en"]) & strong(v["id"]), of("id", sure(v["id"])))
            .when((v["en"] > v["id"]) & strong(v["en"]), of("en", sure(v["en"])))
            .otherwise(of("unknown", "low"))
        )

    count = lambda t: F.struct(s.alias("s"), cjk_ratio(s).alias("ratio"), marker_hits(t, EN_MARKERS).alias("en"), marker_hits(t, ID_MARKERS).alias("id"), F.size(t).alias("n"))
    return let(let(latin_tokens(c), count), judge)


def normalize_source_language(c: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for language, known in SOURCE_CODES.items() for code in known for x in (code, language)))
    s = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    return F.coalesce(F.element_at(codes, s), F.element_at(codes, F.substring_index(s, "-", 1)))


def resolve_language(title: Column, abstract: Column, source_code: Column, manual: Column) -> Column:
    """struct<language, source, confidence, conflict>: a person's word, the source's code unless the title contradicts it,
    the title, the abstract with less confidence, else unknown."""
    of = lambda language, source, confidence, conflict: F.struct(language.alias("language"), F.lit(source).alias("source"), confidence.alias("confidence"), conflict.alias("conflict"))
    no = F.lit(False)

    def judge(v: Column) -> Column:
        t, a, code, hand = v["t"], v["a"], v["code"], v["hand"]
        found, sure = t["language"], t["confidence"] == "high"
        against = ((found == "zh") & (code != "zh")) | ((found == "other") & (code != "other") & sure) | ((found == "id") & (code == "en") & sure)
        return (
            F.when(hand.isNotNull(), of(hand, "manual", F.lit("high"), F.coalesce(code != hand, no)))
            .when(code.isNotNull() & against, of(found, "title", t["confidence"], F.lit(True)))
            .when(code.isNotNull(), of(code, "publisher", F.lit("high"), no))
            .when(found != "unknown", of(found, "title", t["confidence"], no))
            .when(a["language"] != "unknown", of(a["language"], "abstract", F.when(a["confidence"] == "high", "medium").otherwise("low"), no))
            .otherwise(of(F.lit("unknown"), "unknown", F.lit("low"), no))
        )

    hand = F.coalesce(normalize_source_language(manual), F.when(F.lower(manual) == "unknown", "unknown"))
    parts = F.struct(detect_language(title, True).alias("t"), detect_language(abstract, False).alias("a"), normalize_source_language(source_code).alias("code"), hand.alias("hand"))
    return let(parts, judge)


def in_scope(language: Column, wanted: str | None = None) -> Column:
    """One language exactly (null is unknown), or the default scope of Chinese and English."""
    own = F.coalesce(language, F.lit("unknown"))
    return own == wanted if wanted else own.isin("zh", "en")
