"""Registered queries of the package, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import decontaminate, exact_dedup, hard_negatives, html_text, language, mixing, ngram_join, packing, suffix_dedup, token_counts, topk_search, toxicity, vector_codes
from wayline.llm.common import bucket_of
from wayline.plans.registry import Query

QUERIES: dict[str, Query] = {}

#: Parameters of the registered queries.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
KEEP_SPACES = r"[\x20\x09-\x0D]"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = Query(fn, oracle)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op6_token_counts")
def op6(spark, sf):
    lengths = token_counts.encoded_lengths(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))
    return token_counts.limit_table(token_counts.length_histogram(lengths))


@query("op8_packing")
def op8(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), end_id=END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_exact_dedup", rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{KEEP_SPACES}', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
""")  # fmt: skip
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return exact_dedup.classify(docs).select("row.id", *exact_dedup.ADDED).withColumnRenamed("id", "doc_id")


_OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""


@query("op1_ngram_jaccard_join", _OP1)
def op1(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"), width=3, share=90)


@query("op3_toxicity")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(bucket_of("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"))


@query("op5_language_id")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(bucket_of("doc_id", 5) != 0))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_topk_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""")  # fmt: skip
def op9(spark, sf):
    return topk_search.search(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


@query("op7_html_extraction")
def op7(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


#: Target shares of the domains that the labels table tells apart.
WEIGHTS = {"good": 0.9, "poor": 0.1}


def domain_labels(labels: DataFrame) -> DataFrame:
    kind = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", kind.alias("domain"))


@query("op4_mixing")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, domain_labels(table(spark, sf, "labels")), WEIGHTS)
    return mixed.select("doc_id", "tokens", F.round(F.col("posteriors")["good"], 6).alias("good"), F.round("rate", 6).alias("rate"), "copies")


@query("op2_suffix_dedup")
def op2(spark, sf):
    return suffix_dedup.dedup_substrings(table(spark, sf, "documents"), with_text=False)


_OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT item, least(len(w), {decontaminate.WINDOW}) AS n, unnest(list_transform(range(1, greatest(len(w) - {decontaminate.WINDOW - 2}, 2)), lambda i: array_to_string(w[i:i + {decontaminate.WINDOW - 1}], ' '))) AS s FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
o AS (SELECT g.doc_id, g.i, win.n, win.item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM g) g JOIN win ON g.n = win.n AND g.s = win.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op12_decontamination", _OP12)
def op12(spark, sf):
    found = decontaminate.classify(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_hard_negatives", f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
""")  # fmt: skip
def op11(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = hard_negatives.mine(rows, F.col("id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _codes_sql() -> str:
    """The plain method: six rounds over all entries, one materialised step after another."""
    parts = [f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_USABLE}),
x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM v, range(8) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < 16)"""]
    for i in range(7):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, x.p, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT, e := e)) AS m
 FROM x JOIN c{i} ON x.p = c{i}.p GROUP BY ALL)""")
        if i < 6:
            parts.append(f"""s{i} AS (SELECT x.p, m.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM x JOIN a{i} USING (vec_id, p), range(1, len(x) + 1) t(j) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(f.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY ALL) f ON c.p = f.p AND c.e = f.e)""")
    parts.append("""r AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a6 GROUP BY 1),
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)""")
    return ",\n".join(parts) + "\nSELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY v.label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), k"


@query("op13_vector_codes", _codes_sql())
def op13(spark, sf):
    return vector_codes.compress(table(spark, sf, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
