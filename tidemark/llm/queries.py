"""The registered queries of the corpus operators and their DuckDB oracles.

Each query applies its operator, with production parameters, to its whole
table and derives the digest columns from the operator's real outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, linededup, mixing, pii, simhash, tokencount, topk, toxicity, util

#: The file of the public tokenizer whose tokens op10 counts; executors find it where their own installation has it.
VOCABULARY = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select("doc_id", "class_id", "class_size", "keep")


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
z AS (SELECT doc_id FROM d WHERE len(w) = 0),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE both_ >= 0.8 * (x.n + y.n - both_)
 UNION ALL SELECT (SELECT min(doc_id) FROM z), doc_id FROM z),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id FROM d LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS keep FROM c
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontam.decontaminate(docs, util.table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM bs),
ms AS (SELECT DISTINCT m FROM bw),
ds AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM ds),
h AS (SELECT doc_id, dw.m AS m, i, item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", util.held_out().alias("held_out"), "lang_pred", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = util.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP4_SQL = r"""
WITH v AS (SELECT vec_id, [floor(64 * x::double)::bigint for x in embedding] AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e::double[], r.e::double[])::bigint AS score
 FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = util.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = htmltext.extract(pages, htmltext.train(pages))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


#: The key of the registered query; a deployment passes its own.
PSEUDONYM_KEY = b"tidemark demonstration key"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii.pseudonymise(docs, PSEUDONYM_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f.kind))), ",")
    return got.select("doc_id", F.col("pseudonymised").alias("text"), "n_found", kinds.alias("kinds"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, util.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", util.held_out().alias("held_out"), "score", "predicted")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents),
s0 AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::int]::bigint AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
 coalesce(sum(cap) OVER r, 0) AS cap_before, coalesce(sum(weight) OVER r, 0) AS weight_before FROM s1
 WINDOW r AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, weight * (total - cap_before) >= cap * (weights - weight_before) AS capped FROM s2),
s4 AS (SELECT *, total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS shared FROM s3),
s5 AS (SELECT source, source_size, total, (SELECT count(*) FROM s0) AS n, CASE WHEN capped THEN cap::double ELSE (weight * rest)::double / shared::double END AS target FROM s4),
k AS (SELECT *, least(round(target)::bigint, 3 * source_size) AS want FROM s5),
a AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(cast(doc_id AS varchar), '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT doc_id, size, source_size, target,
 ((want // greatest(source_size, 1)) * size + greatest(0, least(size, want % greatest(source_size, 1) - pos)))::bigint AS taken
FROM a JOIN k ON a.source IS NOT DISTINCT FROM k.source
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs)


OP9_SQL = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
k AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
x AS (SELECT k.source, k.line FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE k.n >= 3 AND k.n > 0.02 * t.n),
m AS (SELECT l.*, x.line IS NOT NULL AS bad FROM l LEFT JOIN x ON l.source IS NOT DISTINCT FROM x.source AND trim(l.line, ' ') = x.line),
g AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT bad THEN line END, chr(10) ORDER BY i), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped FROM m GROUP BY doc_id)
SELECT d.doc_id, d.source, g.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN g USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, tokencount.public(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_html_text": op5_html_text,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_toxicity": op7_toxicity,
    "op8_mix_sources": op8_mix_sources,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}
SQL = {"op1_simhash": OP1_SQL, "op2_decontaminate": OP2_SQL, "op4_exact_top_k": OP4_SQL, "op8_mix_sources": OP8_SQL, "op9_line_dedup": OP9_SQL}
