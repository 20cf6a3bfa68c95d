"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, hard_negatives, html_extract, langid, lines, near_dup, packing, phrases, spelling, suffix_dedup, topk, url_filter
from lectern.session import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    judged = ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    return found.select("doc_id", "n_words", "n_hit", n_items, digest, judged)


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0
), p AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM v) AS k, unnest(range(1, len(w) - n + 2)) AS u(i)
), h AS (SELECT r, i, v.n AS n, item FROM p JOIN v ON p.t = v.t AND p.n = v.n),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    models = langid.train(documents, ~held_out)
    return langid.predict(documents, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.size + nb.size - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS at_ FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.at_),
m AS (SELECT doc_id, min(at_) AS component FROM reach GROUP BY 1)
SELECT doc_id, coalesce(size, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.format_conversations(rows))


def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_phrases(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
f AS (SELECT t, min(struct_pack(d := doc_id, i := i)) AS first FROM p GROUP BY t HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS q FROM p JOIN f USING (t) WHERE struct_pack(d := doc_id, i := i) <> first),
k AS (SELECT r, i, x FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) AS a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.r = a.r AND c.q = a.i)),
j AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM k GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN j USING (r)
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_common_lines(table(spark, sf_dir, "documents"), min_documents=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT r, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d) AS a),
f AS (SELECT k FROM e WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
j AS (SELECT r, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS kept FROM e WHERE k NOT IN (SELECT k FROM f) GROUP BY r)
SELECT doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN j USING (r)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte; its table comes from its polynomial.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS u(b))),
w AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) >= 5 GROUP BY 1, 2),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (CAST(unicode(c) AS BIGINT) >> 6), 128 | (CAST(unicode(c) AS BIGINT) & 63)] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM g, t),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h) AS a WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(length(word))) AS u(i)),
p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.rest = b.word),
c AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -n, near := near)) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * v.n THEN best.near END AS form, CASE WHEN -best.n >= 2 * v.n THEN -best.n END AS form_n FROM v LEFT JOIN c USING (word)),
r AS (SELECT word, word AS at_, 0 AS depth FROM f UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON f.word = r.at_ WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(at_, depth) AS root FROM r GROUP BY 1) AS z USING (word)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.labelled(table(spark, sf_dir, "embeddings"), label, scale=256)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (SELECT * FROM (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) AS a WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
) SELECT * FROM n WHERE rank <= 3
"""


QUERIES = {"op1_exact_top_k": op1_exact_top_k, "op2_html_text": op2_html_text, "op3_decontamination": op3_decontamination, "op4_packing": op4_packing, "op5_language_id": op5_language_id, "op6_url_filter": op6_url_filter, "op7_suffix_dedup": op7_suffix_dedup, "op8_near_duplicates": op8_near_duplicates, "op9_chat_format": op9_chat_format, "op10_repeated_phrases": op10_repeated_phrases, "op11_line_dedup": op11_line_dedup, "op12_spelling_variants": op12_spelling_variants, "op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op1_exact_top_k": OP1_SQL, "op3_decontamination": OP3_SQL, "op8_near_duplicates": OP8_SQL, "op10_repeated_phrases": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_hard_negatives": OP13_SQL}
