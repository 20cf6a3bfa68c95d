"""What a text is about: the language field, education or another profession, Chinese as its object.

Terms count as plain substrings of the lower-cased text (`word_boundary` is for topics.count_terms).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.language import let

# --- Fixed values: the term lists below are given, in this order -----------------------------------------------------

#: Technical phrases with words of language in them, hidden before anything is judged.
NEUTRAL = (
    "large language model", "large language models", "llm", "llms", "大语言模型", "大模型", "语言模型", "语言大模型", "natural language processing",
    "natural language understanding", "自然语言处理", "多语言支持", "语言服务", "编程语言",
)
NEUTRAL_MARK = " [技术词] "
#: One of these is enough for the language field.
LANGUAGE_STRONG = (
    "language learning", "language teaching", "language education", "language acquisition", "language teacher", "language learner", "language assessment",
    "language test", "language proficiency", "language pedagogy", "language classroom", "second language", "foreign language", "efl", "esl", "esol", "tefl",
    "tesol", "cfl", "csl", "chinese as a", "academic writing", "english writing", "reading comprehension", "listening comprehension",
    "communicative competence", "interactional competence", "corrective feedback", "二语", "外语", "国际中文", "对外汉语", "语言教学", "语言学习", "语言能力",
    "语言测评", "习得", "交际能力", "中介语",
)
#: Objects of linguistic research, which need an academic context.
LANGUAGE_SUBJECT = (
    "linguistic", "linguistics", "phonolog", "phonetic", "pronunciation", "morpholog", "pragmatic", "pragmatics", "speech act", "vocabulary", "grammar",
    "syntax", "semantic", "lexical", "discourse", "bilingual", "multilingual", "translanguag", "interlanguage", "plurilingual", "mandarin", "putonghua",
    "hanzi", "pinyin", "chinese character", "interpreting", "collocation", "fluency", "汉语", "中文", "汉字", "拼音", "普通话", "词汇", "语法", "句法", "语义",
    "语用", "语音", "音系", "语料库", "华语", "语言学", "语篇", "话语",
)
ACADEMIC_CONTEXT = (
    "learner", "learners", "learning", "teaching", "acquisition", "student", "students", "classroom", "pedagog", "instruction", "curriculum", "course",
    "proficiency", "assessment", "test", "corpus", "error", "errors", "transfer", "development", "education", "educational", "textbook", "syllabus",
    "teacher", "teachers", "学习", "学习者", "学生", "教学", "课堂", "课程", "习得", "教育", "教师", "能力", "水平",
)
#: Weak signs, which need an anchor.
LANGUAGE_WEAK = ("literacy", "reading", "writing", "listening", "speaking", "translation", "accuracy", "阅读", "写作", "听力", "口语", "翻译", "口译", "准确")
LANGUAGE_ANCHOR = (
    "language learning", "language teaching", "language education", "language acquisition", "language teacher", "language learner", "language assessment",
    "language proficiency", "second language", "foreign language", "efl", "esl", "tefl", "tesol", "chinese as a", "language classroom", "language pedagogy",
    "translating", "interpreting", "二语", "外语", "国际中文", "对外汉语", "语言教学", "语言学习", "语言能力", "语言测评", "习得",
)
#: Learners and teaching as the object of a study.
EDUCATION_OBJECT = (
    "student", "students", "learner", "learners", "pupil", "pupils", "trainee", "trainees", "classroom", "classrooms", "curriculum", "teaching", "teacher",
    "teachers", "pedagog", "learning outcome", "learning outcomes", "learning gain", "learning gains", "student performance", "student learning",
    "instructional design", "课堂", "课程", "教学", "教师", "学员", "学习者", "学生", "教学法",
)
#: The same in a title, where more words count.
EDUCATION_TITLE = (
    "education", "educational", "teaching", "pedagog", "curriculum", "classroom", "learner", "learners", "student", "students", "pupil", "trainee",
    "trainees", "instruction", "instructional", "course", "courses", "school", "university", "college", "training", "teacher", "teachers", "literacy",
    "教育", "教学", "课程", "课堂", "教师", "学员", "学生", "学习者", "培训",
)
#: Objects of medicine, pharmacy and occupational health.
OTHER_OBJECT = (
    "patient", "patients", "clinical", "clinician", "clinicians", "disease", "disorder", "diagnosis", "diagnostic", "therapy", "therapeutic", "treatment",
    "symptom", "symptoms", "prevalence", "alzheimer", "dementia", "cognitive impairment", "rehabilitation", "nurse", "nurses", "physician", "physicians",
    "medical", "medicine", "medication", "dosage", "drug", "drugs", "pharmac", "prescription", "comorbidity", "placebo", "dentistry", "dental", "implant",
    "prosthodont", "surgical", "surgery", "health advice", "healthcare", "health care", "occupational", "workplace", "sedentary", "office worker",
    "office workers", "public health", "epidemiolog", "患者", "临床", "疾病", "诊断", "治疗", "药物", "护理", "康复", "健康", "职业健康", "流行病", "口腔", "牙科",
    "种植牙",
)
#: Chinese, or its teaching, as the object.
CHINESE_FOCUS = (
    "chinese language", "mandarin chinese", "modern chinese", "standard chinese", "chinese syntax", "chinese grammar", "chinese phonology",
    "chinese phonetics", "chinese character", "chinese characters", "chinese corpus", "chinese linguistics", "chinese vocabulary", "chinese reading",
    "chinese writing", "chinese pronunciation", "chinese listening", "chinese speaking", "chinese pragmatic", "chinese discourse", "chinese as a second",
    "chinese as a foreign", "chinese as an additional", "chinese language teaching", "chinese language learning", "chinese language education",
    "international chinese", "chinese teaching", "chinese learning", "chinese learners", "chinese education", "learning of chinese", "teaching of chinese",
    "learning chinese", "teaching chinese", "cfl", "csl", "putonghua", "hanzi", "pinyin", "han character", "tone sandhi", "measure word", "classifier",
    "汉语", "中文", "汉字", "拼音", "普通话", "现代汉语", "汉语语法", "汉语方言", "汉语语音", "汉语词汇", "汉语语用", "汉语教学", "汉语学习", "中文教学", "华语", "国际中文",
    "对外汉语", "文言", "量词", "声调",
)
#: Weights of artificial intelligence, pedagogy and Chinese in the value of a study.
VALUE_WEIGHTS = (0.35, 0.25, 0.3)

# --- end of the fixed values ----------------------------------------------------------------------------------------


def neutral(text: Column) -> Column:
    """The lower-cased text with technical phrases hidden, one after the other."""
    return reduce(lambda t, n: F.replace(t, F.lit(n), F.lit(NEUTRAL_MARK)), NEUTRAL, F.lower(F.coalesce(text, F.lit(""))))


def terms_in(text: Column, terms: tuple[str, ...]) -> Column:
    """Those of the terms that are substrings of a lower-cased text, in the order of the list."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def language_domain(text: Column) -> Column:
    """struct<in_domain, tier>: a strong term; else an object with academic context; else a weak sign with an anchor."""

    def judge(t: Column) -> Column:
        any_of = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(t, x))
        tier = F.when(any_of(LANGUAGE_STRONG), "edu").when(any_of(LANGUAGE_SUBJECT) & any_of(ACADEMIC_CONTEXT), "subject+context").when(any_of(LANGUAGE_WEAK) & any_of(LANGUAGE_ANCHOR), "weak+anchor")
        return F.struct(tier.isNotNull().alias("in_domain"), F.coalesce(tier, F.lit("none")).alias("tier"))

    return let(neutral(text), judge)


def research_object(text: Column, title: Column) -> Column:
    """struct<education, other, is_education, not_education>: numbers of terms (each once, of title or text), and which prevail."""

    def judge(v: Column) -> Column:
        counts = F.struct(F.size(F.array_union(terms_in(v["title"], EDUCATION_TITLE), terms_in(v["text"], EDUCATION_OBJECT))).alias("education"), F.size(terms_in(v["text"], OTHER_OBJECT)).alias("other"))
        return let(counts, lambda n: F.struct(n["education"].alias("education"), n["other"].alias("other"), (n["education"] > 0).alias("is_education"), ((n["other"] >= 1) & (n["other"] >= n["education"])).alias("not_education")))

    return let(F.struct(neutral(text).alias("text"), neutral(title).alias("title")), judge)


def has_chinese_focus(text: Column) -> Column:
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.exists(F.array(*map(F.lit, CHINESE_FOCUS)), lambda t: F.contains(low, t)))


def research_value(text: Column, ai: tuple[str, ...], pedagogy: tuple[str, ...], chinese: tuple[str, ...]) -> Column:
    """0 to 1 from the numbers of terms of three lists that the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    raw = sum((F.size(terms_in(low, terms)) * w for terms, w in zip((ai, pedagogy, chinese), VALUE_WEIGHTS, strict=True)), F.lit(0.0))
    return F.least(F.lit(1.0), raw)
