"""Queries for per-document text features (A3, C1-C19) over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.functions.columns import rounded
from wayline.operators import lexicon, scorer, valence
from wayline.plans.registry import query
from wayline.session import spread
from wayline.sources.bindings import DOCS_SQL, MESSAGES_SQL, document_texts, message_texts, table

# Lexicon of the demonstration queries: tokens of the synthetic corpora with (valence, polarity, subjectivity, class).
LEXICON = [
    ("the", 0.5, 0.1, 0.2, "DT"), ("and", 0.4, 0.05, 0.1, "CC"), ("que", -0.6, -0.2, 0.3, "CS"), ("les", 0.7, 0.15, 0.25, "DT"),
    ("de", -0.3, -0.1, 0.15, "IN"), ("en", -1.2, -0.4, 0.6, "IN"), ("on", 1.1, 0.3, 0.5, "VB"), ("is", 0.2, 0.0, 0.1, "VB"),
    ("was", -0.8, -0.25, 0.35, "VB"), ("der", 0.9, 0.2, 0.4, "DT"), ("die", -1.5, -0.5, 0.7, "DT"), ("und", 0.3, 0.1, 0.2, "CC"),
    ("ist", 0.6, 0.2, 0.3, "VB"), ("aux", -0.4, -0.1, 0.2, "IN"), ("ou", 0.8, 0.25, 0.45, "CC"), ("est", 1.3, 0.35, 0.55, "VB"),
]
VALUES = ", ".join(f"('{t}', {v}::DOUBLE, {p}::DOUBLE, {s}::DOUBLE, '{c}')" for t, v, p, s, c in LEXICON)
LEX_SQL = f"lex(token, valence, polarity, subjectivity, class) AS (VALUES {VALUES})"
STOPS = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)


def lexicon_table(spark):
    # A constant of a few rows; a lexicon read from a table is left to Spark's own measure.
    return F.broadcast(spark.createDataFrame(LEXICON, "token string, valence double, polarity double, subjectivity double, class string"))


def docs(spark, sf):
    return spread(document_texts(spark, sf).select("doc_id", "text"), "doc_id")


TOK = f"tk AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{X.TOKEN}') AS tok FROM docs)"
D = f"WITH {DOCS_SQL}, {TOK} "
V = X.VOWEL
CNT = f"""ct AS (SELECT doc_id, text, tok, len(tok) AS n, len(list_distinct(tok)) AS u, greatest(len(regexp_extract_all(text, '{X.SENTENCE}')), 1) AS s,
  length(replace(text, ' ', '')) AS c, len(list_filter(tok, lambda t: t IN ({STOPS}))) AS f,
  coalesce(list_sum(list_transform(tok, lambda t: greatest(1, len(regexp_extract_all(t, '[{V}]+'))))), 0) AS y,
  len(list_filter(tok, lambda t: len(regexp_extract_all(t, '[{V}]+')) >= 3)) AS x, regexp_matches(text, '\\S') AS live FROM tk)"""
DC = D.rstrip() + ", " + CNT + " "


@query("A3_skip_blank_documents", f"WITH {DOCS_SQL}, {MESSAGES_SQL}, a AS (SELECT text FROM docs UNION ALL SELECT text FROM msgs UNION ALL SELECT regexp_extract(text, '^\\s*') FROM docs) "
       "SELECT regexp_matches(text, '\\S') AS has_text, count(*) AS n FROM a GROUP BY 1")
def a3(spark, sf):
    d = docs(spark, sf).select("text")
    blanks = d.select(F.regexp_extract("text", r"^\s*", 0).alias("text"))
    every = d.unionByName(message_texts(spark, sf).select("text")).unionByName(blanks)
    return every.groupBy((~X.is_blank(F.col("text"))).alias("has_text")).agg(F.count(F.lit(1)).alias("n"))


@query("C1_tokens", D + ", x AS (SELECT doc_id, unnest(tok) AS token FROM tk) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM x GROUP BY 1")
def c1(spark, sf):
    return lexicon.token_counts(docs(spark, sf), ["doc_id"]).groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("C2_sentences", DC + "SELECT doc_id, CAST(s AS INTEGER) AS num_sentences FROM ct")
def c2(spark, sf):
    return docs(spark, sf).select("doc_id", X.num_sentences(F.col("text")).alias("num_sentences"))


def _style(name, sql, cols, digits=8):
    sel = ", ".join(f"{e} AS {c}" for c, e in zip(cols, sql))

    @query(name, DC + f"SELECT doc_id, {sel} FROM ct")
    def run(spark, sf):
        return rounded(X.style_features(docs(spark, sf)).select("doc_id", *cols), digits)

    return run


_style("C3_num_words", ["n"], ["num_words"])
_style("C4_word_diversity", ["round(coalesce(u / nullif(n, 0), 0), 8)"], ["word_diversity"])
_style("C5_average_word_length", ["round(coalesce(c / nullif(n, 0), 0), 8)"], ["average_word_length"])
_style("C6_avg_sentence_length", ["round(n / s, 8)"], ["avg_sentence_length"])
_style("C7_function_word_ratio", ["round(coalesce(f / nullif(n, 0), 0), 8)", "round(1 - coalesce(f / nullif(n, 0), 0), 8)"],
       ["function_word_ratio", "content_word_ratio"])
FLESCH = "round(206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * coalesce(y / nullif(n, 0), 0), 6)"
FOG = "round(0.4::DOUBLE * (n / s + 100.0::DOUBLE * coalesce(x / nullif(n, 0), 0)), 6)"
_style("C9_flesch_reading_ease", [FLESCH], ["flesch_reading_ease"], 6)
_style("C10_gunning_fog", [FOG], ["gunning_fog"], 6)

LEXJ = D.rstrip() + f", {LEX_SQL}, x AS (SELECT doc_id, unnest(tok) AS token FROM tk), j AS (SELECT * FROM x LEFT JOIN lex USING (token)) "
VADER = """coalesce(sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END), 0) AS p, coalesce(sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0 END), 0) AS g,
 sum(CASE WHEN coalesce(valence, 0) = 0 THEN 1 ELSE 0 END) AS z, coalesce(sum(valence), 0) AS s"""
VSEL = """round(coalesce(p / nullif(p + g + z, 0), 0), 8) AS vader_pos, round(coalesce(z / nullif(p + g + z, 0), 0), 8) AS vader_neu,
 round(coalesce(g / nullif(p + g + z, 0), 0), 8) AS vader_neg, round(s / sqrt(s * s + 15), 8) + 0.0 AS vader_compound"""


@query("C8_token_class_ratio", LEXJ + ", r AS (SELECT doc_id, count(*) FILTER (class = 'VB') / count(*) AS v FROM j GROUP BY 1) "
       "SELECT docs.doc_id, round(coalesce(v, 0), 8) AS verb_ratio FROM docs LEFT JOIN r USING (doc_id)")
def c8(spark, sf):
    return rounded(lexicon.class_ratio(docs(spark, sf), ["doc_id"], lexicon_table(spark).select("token", "class"), "VB"), 8)


@query("C11_valence", LEXJ + f", r AS (SELECT doc_id, {VADER} FROM j GROUP BY 1), q AS (SELECT docs.doc_id, coalesce(p, 0) AS p, coalesce(g, 0) AS g, coalesce(z, 0) AS z, coalesce(s, 0) AS s FROM docs LEFT JOIN r USING (doc_id)) SELECT doc_id, {VSEL} FROM q")
def c11(spark, sf):
    return rounded(lexicon.valence(docs(spark, sf), ["doc_id"], lexicon_table(spark).select("token", "valence")), 8)


# A lexicon learned from the labelled documents, and words of these corpora beside the rules' own.
LEARNED = f"""{DOCS_SQL}, kd AS (SELECT quality AS y, list_distinct(regexp_extract_all(lower(text), '{X.TOKEN}')) AS t FROM docs JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
 sz AS (SELECT count(*) FILTER (y = 1) AS g, count(*) FILTER (y = 0) AS p FROM kd), ke AS (SELECT token, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM (SELECT y, unnest(t) AS token FROM kd) GROUP BY 1 HAVING count(*) >= 3),
 lx AS MATERIALIZED (SELECT token, floor(40 * (a / g - b / p) / (a / g + b / p) + 0.5::DOUBLE) / 10 AS valence FROM ke, sz)"""
OWN = {"the": valence.STRONGER, "und": valence.STRONGER, "les": -valence.STRONGER}
RULES = valence.Rules(valence.Rules().boosters | OWN, [*valence.NEGATIONS, "der", "que"])


def learned(spark, sf):
    d = document_texts(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return valence.learned_lexicon(d, "quality")


def loud(text):
    """Texts with shouted words, exclamation marks, and "but" in place of a word."""
    shouted = F.regexp_replace(F.regexp_replace(text, r"\bis\b", "but"), r"\b(was|and|der)\b", "OH")
    return F.regexp_replace(F.regexp_replace(shouted, r"\.", "!"), "OH", "AND")


LOUD = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bis\b', 'but', 'g'), '\b(was|and|der)\b', 'OH', 'g'), '\.', '!', 'g'), 'OH', 'AND', 'g')"


def _context_sql() -> str:
    """The rules by position: every word next to the three before it."""
    boosts = ", ".join(f"('{w}', {b}::DOUBLE)" for w, b in RULES.boosters.items())
    negated = ", ".join(f"'{w}'" for w in RULES.negations)
    cap = "CASE WHEN v > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END"
    out = f"""WITH {LEARNED}, bo(w, b) AS (VALUES {boosts}), tx AS (SELECT doc_id, {LOUD} AS text FROM docs),
 ws AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:''\\p{{L}}+)?') AS w FROM tx), ux AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM ws),
 a AS (SELECT doc_id, i, lower(u.w) AS w, valence, coalesce(b, 0) AS b, upper(u.w) = u.w AND lower(u.w) <> u.w AS caps, lower(u.w) IN ({negated}) OR contains(lower(u.w), 'n''t') AS neg FROM ux u LEFT JOIN lx ON lx.token = lower(u.w) LEFT JOIN bo ON bo.w = lower(u.w)),
 m AS (SELECT *, count(*) FILTER (caps) OVER d BETWEEN 1 AND count(*) OVER d - 1 AS mixed, min(CASE WHEN w = 'but' THEN i END) OVER d AS bi,
   valence IS NOT NULL AND b = 0 AND NOT (w = 'kind' AND coalesce(lead(w) OVER o, '') = 'of') AS scored, """ + ", ".join(
        f"lag(w, {k}) OVER o AS w{k}, lag(valence, {k}) OVER o AS k{k}, lag(b, {k}) OVER o AS b{k}, lag(caps, {k}) OVER o AS c{k}, lag(neg, {k}) OVER o AS n{k}" for k in (1, 2, 3)) + f"""
   FROM a WINDOW d AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY i)),
 v0 AS (SELECT *, CASE WHEN scored THEN valence ELSE 0 END AS v FROM m), s0 AS (SELECT * EXCLUDE (v), CASE WHEN scored AND caps AND mixed THEN v + {cap} ELSE v END AS v FROM v0)"""
    lifts = {1: "false", 2: "w2 = 'never' AND w1 IN ('so', 'this')", 3: "w3 = 'never' AND (w1 IN ('so', 'this') OR w2 IN ('so', 'this'))"}
    for k in (1, 2, 3):
        near, lift = {1: 1.0, 2: 0.95, 3: 0.9}[k], {1: 1.0, 2: 1.5, 3: 1.25}[k]
        out += f""", t{k} AS (SELECT * EXCLUDE (v), scored AND i >= {k} AND k{k} IS NULL AS here, v + CASE WHEN scored AND i >= {k} AND k{k} IS NULL THEN {near}::DOUBLE * ((CASE WHEN v < 0 THEN -b{k} ELSE b{k} END) + CASE WHEN b{k} <> 0 AND c{k} AND mixed THEN {cap} ELSE 0 END) ELSE 0 END AS v FROM s{k - 1}),
 s{k} AS (SELECT * EXCLUDE (v, here), CASE WHEN here AND ({lifts[k]}) THEN v * {lift}::DOUBLE WHEN here AND n{k} THEN v * -0.74::DOUBLE ELSE v END AS v FROM t{k})"""
    return out + """, e AS (SELECT *, CASE WHEN scored AND i >= 1 AND k1 IS NULL AND w1 = 'least' AND NOT (i >= 2 AND w2 IN ('at', 'very')) THEN v * -0.74::DOUBLE ELSE v END AS x FROM s3),
 f AS (SELECT doc_id, CASE WHEN bi IS NULL OR i = bi THEN x WHEN i < bi THEN x * 0.5::DOUBLE ELSE x * 1.5::DOUBLE END AS x FROM e),
 r AS (SELECT doc_id, sum(x) AS s, sum(CASE WHEN x > 0 THEN x + 1 ELSE 0 END) AS p, sum(CASE WHEN x < 0 THEN 1 - x ELSE 0 END) AS g, count(*) FILTER (x = 0) AS z FROM f GROUP BY 1),
 q AS (SELECT doc_id, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN k > 3 THEN 0.96::DOUBLE WHEN k > 1 THEN k * 0.18::DOUBLE ELSE 0 END AS more FROM (SELECT *, length(text) - length(replace(text, '?', '')) AS k FROM tx)),
 h AS (SELECT doc_id, coalesce(s, 0) + sign(coalesce(s, 0)) * more AS s, coalesce(p, 0) + CASE WHEN p > g THEN more ELSE 0 END AS p, coalesce(g, 0) + CASE WHEN g > p THEN more ELSE 0 END AS g, coalesce(z, 0) AS z FROM q LEFT JOIN r USING (doc_id))
 SELECT doc_id, """ + VSEL.replace(", 8)", ", 6)") + " FROM h"


@query("C11_learned_lexicon", f"WITH {LEARNED} SELECT token, valence, valence / 4 AS polarity, abs(valence / 4) AS subjectivity FROM lx")
def c11l(spark, sf):
    return learned(spark, sf)


@query("C11_valence_in_context", _context_sql())
def c11c(spark, sf):
    d = document_texts(spark, sf).select("doc_id", loud(F.col("text")).alias("text"))
    return rounded(valence.lexicon_scores(d, learned(spark, sf), rules=RULES).select("doc_id", *valence.SCORES[:4]), 6)


@query("C12_learned_polarity", f"""WITH {LEARNED}, x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{X.TOKEN}')) AS token FROM docs), r AS (SELECT doc_id, avg(valence / 4) AS p, avg(abs(valence / 4)) AS s FROM x LEFT JOIN lx USING (token) GROUP BY 1)
 SELECT docs.doc_id, round(coalesce(p, 0), 7) + 0.0 AS polarity, round(coalesce(s, 0), 7) AS subjectivity FROM docs LEFT JOIN r USING (doc_id)""")
def c12l(spark, sf):
    d = document_texts(spark, sf).select("doc_id", "text")
    return rounded(valence.lexicon_scores(d, learned(spark, sf)).select("doc_id", "polarity", "subjectivity"), 7)


@query("C12_polarity_subjectivity", LEXJ + """, r AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM j GROUP BY 1)
 SELECT docs.doc_id, round(coalesce(p, 0), 8) + 0.0 AS polarity, round(coalesce(s, 0), 8) AS subjectivity FROM docs LEFT JOIN r USING (doc_id)""")
def c12(spark, sf):
    lex = lexicon_table(spark).select("token", "polarity", "subjectivity")
    return rounded(lexicon.mean_scores(docs(spark, sf), ["doc_id"], lex), 8)


@query("C13_trait_scores", D + """, h AS (SELECT doc_id, greatest(len(tok), 1) AS n, list_transform(tok, lambda t: (('0x' || md5(t)[1:2])::INTEGER) % 5) AS sl FROM tk),
 l AS (SELECT doc_id, list_transform(range(0, 5), lambda i: len(list_filter(sl, lambda s: s = i)) / n * 5.0::DOUBLE) AS lg FROM h),
 e AS (SELECT doc_id, list_transform(lg, lambda x: exp(x - list_max(lg))) AS ex FROM l)
 SELECT doc_id, """ + ", ".join(f"round(ex[{i + 1}] / list_sum(ex), 8) AS {t}" for i, t in enumerate(scorer.TRAITS)) + " FROM e")
def c13(spark, sf):
    return rounded(scorer.trait_scores(docs(spark, sf), ["doc_id"]), 8)


def _load_encoder():
    """Stand-in encoder: counts of character codes folded into 16 cells, scaled to length one."""
    import numpy as np

    def encode(texts):
        out = np.zeros((len(texts), 16))
        for row, t in zip(out, texts):
            codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % 16
            row += np.bincount(codes.astype(np.int64), minlength=16)
            row /= max(np.linalg.norm(row), 1e-12)
        return out

    return encode


@query("C14_document_embedding", f"""WITH {DOCS_SQL}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM docs), k AS (SELECT doc_id, unicode(ch) % 16 AS dim, count(*) AS n FROM c GROUP BY ALL),
 g AS (SELECT doc_id, unnest(range(16)) AS dim FROM docs), f AS (SELECT g.doc_id, g.dim, coalesce(n, 0) AS n FROM g LEFT JOIN k USING (doc_id, dim))
 SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(n / greatest(sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 1e-12), 8) AS value FROM f""")
def c14(spark, sf):
    v = scorer.map_texts(docs(spark, sf), ["doc_id"], _load_encoder)
    return v.select("doc_id", F.posexplode("vec").alias("dim", "value")).select("doc_id", "dim", F.round("value", 8).alias("value"))


@query("C15_legacy_features", f"""WITH {DOCS_SQL}, t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS lt FROM docs),
 w AS (SELECT doc_id, list_filter(string_split(lt, ' '), lambda x: x <> '') AS w FROM t), l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lo FROM w),
 c AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS u, len(list_filter(lo, lambda x: x IN ({STOPS}))) AS f,
   len(list_filter(lo, lambda x: len(regexp_extract_all(x, '[{V}]+')) >= 3)) AS x, coalesce(list_sum(list_transform(lo, lambda x: greatest(1, len(regexp_extract_all(x, '[{V}]+'))))), 0) AS y FROM l)
 SELECT doc_id, CASE WHEN n < 10 THEN 0.0::DOUBLE ELSE n END AS num_words, CASE WHEN n < 10 THEN 0 ELSE round(n / (1 + 1e-5::DOUBLE), 6) END AS avg_sentence_length,
  CASE WHEN n < 10 THEN 0 ELSE round(u / (n + 1e-5::DOUBLE), 6) END AS word_diversity,
  CASE WHEN n < 10 THEN 0 ELSE round(206.835::DOUBLE - 1.015::DOUBLE * n - 84.6::DOUBLE * (y / n), 6) END AS flesch_reading_ease,
  CASE WHEN n < 10 THEN 0 ELSE round(0.4::DOUBLE * (n + 100.0::DOUBLE * (x / n)), 6) END AS gunning_fog,
  CASE WHEN n < 10 THEN 0 ELSE round(f / (n + 1e-5::DOUBLE), 6) END AS function_word_ratio, CASE WHEN n < 10 THEN 0 ELSE round(1 - f / (n + 1e-5::DOUBLE), 6) END AS content_word_ratio FROM c""")
def c15(spark, sf):
    return rounded(X.legacy_features(docs(spark, sf)).drop("text"), 6)


@query("C15_legacy_nine_features", f"""WITH {LEARNED}, t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS lt FROM docs),
 w AS (SELECT doc_id, list_filter(string_split(lt, ' '), lambda x: x <> '') AS w FROM t), x AS (SELECT doc_id, unnest(list_transform(w, lambda x: lower(x))) AS token FROM w),
 r AS (SELECT doc_id, avg(valence / 4) AS p, avg(abs(valence / 4)) AS s FROM x LEFT JOIN lx USING (token) GROUP BY 1)
 SELECT doc_id, CASE WHEN len(w) < 10 THEN 0.0::DOUBLE ELSE len(w) END AS num_words, CASE WHEN len(w) < 10 THEN 0 ELSE round(coalesce(p, 0), 6) + 0.0 END AS polarity, CASE WHEN len(w) < 10 THEN 0 ELSE round(coalesce(s, 0), 6) END AS subjectivity FROM w LEFT JOIN r USING (doc_id)""")
def c15n(spark, sf):
    """The nine legacy columns: polarity and subjectivity over the same letters-only text, 0 below ten words."""
    out = valence.legacy_scores(docs(spark, sf), learned(spark, sf))
    return rounded(out.select("doc_id", "num_words", "polarity", "subjectivity"), 6)


STYLE_SQL = f"""CASE WHEN live THEN n ELSE 0 END AS num_words, CASE WHEN live THEN round(coalesce(u / nullif(n, 0), 0), 6) ELSE 0 END AS word_diversity,
 CASE WHEN live THEN round(coalesce(c / nullif(n, 0), 0), 6) ELSE 0 END AS average_word_length, CASE WHEN live THEN round(n / s, 6) ELSE 0 END AS avg_sentence_length,
 CASE WHEN live THEN round(coalesce(f / nullif(n, 0), 0), 6) ELSE 0 END AS function_word_ratio, CASE WHEN live THEN round(1 - coalesce(f / nullif(n, 0), 0), 6) ELSE 0 END AS content_word_ratio,
 CASE WHEN live THEN {FLESCH} ELSE 0 END AS flesch_reading_ease, CASE WHEN live THEN {FOG} ELSE 0 END AS gunning_fog"""


@query("C16_blank_text_defaults", DC.replace("FROM documents)", "FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN regexp_extract(text, '^\\s*') ELSE text END AS text, * EXCLUDE (text) FROM documents))") + f"SELECT doc_id, {STYLE_SQL} FROM ct")
def c16(spark, sf):
    holed = docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_extract("text", r"^\s*", 0)).otherwise(F.col("text")))
    return rounded(X.style_features(holed).drop("text"), 6)


def document_features(df, lex):
    """All fifteen features in one pass: style columns ride along in the document's row, whose words meet the lexicon there."""
    return valence.lexicon_scores(X.style_features(df), lex)


@query("C17_all_features", DC.rstrip() + f""", {LEX_SQL}, x AS (SELECT doc_id, unnest(tok) AS token FROM tk), j AS (SELECT * FROM x LEFT JOIN lex USING (token)),
 r AS (SELECT doc_id, {VADER}, avg(polarity) AS pol, avg(subjectivity) AS sub, count(*) FILTER (class = 'VB') / count(*) AS vr FROM j GROUP BY 1),
 q AS (SELECT docs.doc_id, coalesce(p, 0) AS p, coalesce(g, 0) AS g, coalesce(z, 0) AS z, coalesce(s, 0) AS s, coalesce(pol, 0) AS pol, coalesce(sub, 0) AS sub, coalesce(vr, 0) AS vr FROM docs LEFT JOIN r USING (doc_id)),
 o AS (SELECT doc_id, {VSEL.replace(', 8)', ', 6)')}, round(pol, 6) + 0.0 AS polarity, round(sub, 6) AS subjectivity, round(vr, 6) AS verb_ratio FROM q)
 SELECT * FROM o JOIN (SELECT doc_id, {STYLE_SQL} FROM ct) USING (doc_id)""")
def c17(spark, sf):
    return rounded(document_features(docs(spark, sf), lexicon_table(spark)), 6)


@query("C18_whitespace_words", f"WITH {MESSAGES_SQL} SELECT author_id, item, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words FROM msgs")
def c18(spark, sf):
    return message_texts(spark, sf).select("author_id", "item", X.whitespace_words(F.col("text")).alias("words"))


@query("C19_clean_output", f"""WITH {MESSAGES_SQL}, m AS (SELECT author_id, item, CASE item % 3 WHEN 0 THEN ' > ' || text WHEN 1 THEN '>>' || text ELSE text END AS t FROM msgs),
 c AS (SELECT author_id, item, regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '^>\\s*', '') AS t FROM m)
 SELECT author_id, item, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM c""")
def c19(spark, sf):
    t = F.col("text")
    m = message_texts(spark, sf).withColumn("text", F.when(F.col("item") % 3 == 0, F.concat(F.lit(" > "), t)).when(F.col("item") % 3 == 1, F.concat(F.lit(">>"), t)).otherwise(t))
    c = X.clean_output(F.col("text"))
    return m.select("author_id", "item", c.alias("t")).select("author_id", "item", F.md5("t").alias("digest"), F.length("t").alias("chars"))
