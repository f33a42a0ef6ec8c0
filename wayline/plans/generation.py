"""Queries for corpus planning, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import names as N
from wayline.functions import prompts as P
from wayline.functions.columns import rounded
from wayline.operators import genplan, report
from wayline.plans.metadata import CAP_SQL, FIELD_SQL, FLAG_PATHS, BASE, flagged_paths
from wayline.plans.registry import query
from wayline.sources.bindings import MESSAGES_SQL, NAMES_SQL, corpus_names, message_texts

W = "WITH " + NAMES_SQL
EXPECTED = f"""ex AS (SELECT id, lv AS level, {CAP_SQL} || '_' || {FIELD_SQL} || '_' || batch || '_' || year || '_' || index || '_G4B_LV' || lv || '.txt' AS filename
  FROM (SELECT * EXCLUDE (level) FROM names), (SELECT unnest([1, 2, 3]) AS lv)),
 have AS (SELECT DISTINCT filename FROM ex WHERE md5(filename)[1] < '6')"""


def expected(spark, sf):
    return genplan.expected_outputs(corpus_names(spark, sf).drop("filename", "level"), [1, 2, 3], "GEMMA_4B").select("id", "level", "filename")


def existing(exp):
    return exp.where(F.substring(F.md5("filename"), 1, 1) < "6").select("filename")


@query("D13_pending_work", f"{W}, {EXPECTED} SELECT id, level, filename FROM ex WHERE filename NOT IN (SELECT filename FROM have)")
def d13(spark, sf):
    exp = expected(spark, sf)
    return genplan.pending(exp, existing(exp)).select("id", "level", "filename")


@query("M1_work_plan", f"{W}, {EXPECTED} SELECT level, count(*) FILTER (h.filename IS NULL) AS to_process, count(h.filename) AS existing, count(*) AS total FROM ex LEFT JOIN have h USING (filename) GROUP BY 1")
def m1(spark, sf):
    exp = expected(spark, sf)
    return genplan.work_plan(exp, existing(exp))


def generation_docs(spark, sf):
    """Messages as source texts with synthetic metadata, one row per level; some arrive twice."""
    m = message_texts(spark, sf).withColumns({
        "path": F.concat_ws("/", F.lit("data"), F.col("author_id").cast("string"), F.col("item").cast("string")),
        "genre": F.element_at(F.array(F.lit("news"), F.lit("blogs"), F.lit("academic")), (F.pmod("author_id", F.lit(3)) + 1).cast("int")),
        "subfield": F.concat(F.lit("sub"), F.pmod("author_id", F.lit(4)).cast("string")),
        "year": (F.pmod("author_id", F.lit(5)) + 2018).cast("string"), "index": F.format_string("%02d", F.col("item"))})
    return m.withColumn("level", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(2))))


GEN = f"""{MESSAGES_SQL}, gd AS (SELECT 'data/' || author_id || '/' || item AS path, ['News', 'Blogs', 'Academic'][author_id % 3 + 1] AS genre, 'sub' || (author_id % 4) AS subfield,
   CAST(author_id % 5 + 2018 AS VARCHAR) AS year, printf('%02d', item) AS idx, text, len(regexp_extract_all(text, '\\S+')) AS words FROM msgs)"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(rows):
    return "CASE " + " ".join(f"WHEN genre = '{g}' AND level = {lv} THEN {_sql_text(t)}" for g, lv, t in rows) + " END"


TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
USER_SQL = ("'HUMAN METADATA\n- genre: ' || genre || '\n- subfield: ' || subfield || '\n- year: ' || year || '\n- level: LV' || level || '\n- model: GEMMA_4B\n- identifier: '"
            " || genre || '_' || subfield || '_' || year || '_' || idx || '\n\n\nHUMAN TEXT\n\"\"\"' || " + TRIM + " || '\"\"\"\n\n' || " + _sql_text(P.USER_TAIL))


@query("M2_request_dedup", f"WITH {GEN} SELECT level, count(*) AS requests FROM gd, (SELECT unnest([1, 2, 3]) AS level) GROUP BY 1")
def m2(spark, sf):
    return generation_docs(spark, sf).dropDuplicates(["path", "level"]).groupBy("level").agg(F.count(F.lit(1)).alias("requests"))


@query("M3_extraction_prompts", f"WITH {GEN}, l AS (SELECT *, unnest([1, 2, 3]) AS level FROM gd) SELECT path, level, md5({_case(P.template_rows(P.EXTRACTION))}) AS system_digest, md5({USER_SQL}) AS user_digest FROM l")
def m3(spark, sf):
    r = genplan.extraction_requests(generation_docs(spark, sf), "GEMMA_4B")
    return r.select("path", "level", F.md5("system_prompt").alias("system_digest"), F.md5("user_prompt").alias("user_digest"))


def _style_sql():
    args = {"%1$s": "' || subfield || '", "%2$s": "' || words || '", "%3$s": "' || year || '", "%%": "%",
            "%4$s": "' || greatest(1, CAST(floor(words * 0.95::DOUBLE) AS BIGINT)) || '", "%5$s": "' || CAST(floor(words * 1.05::DOUBLE) AS BIGINT) || '"}
    out = "CASE genre"
    for g, s in P.STYLES.items():
        t = s.replace("'", "''")
        for k, v in args.items():
            t = t.replace(k, v)
        out += f" WHEN '{g}' THEN '{t}'"
    return out + " END"


@query("M4_generation_prompts", f"""WITH {GEN}, l AS (SELECT *, unnest([1, 2, 3]) AS level FROM gd)
 SELECT path, level, md5('Here is a summary of a human-written ' || lower(genre) || ' text:\n\nKeywords: ' || subfield || ', ' || year || '\nSummary: ' || {TRIM} || '\n' || '\n\n' || {_case(P.template_rows(P.PREAMBLES))} || '\n\n' || {_style_sql()}) AS digest FROM l""")
def m4(spark, sf):
    rows = generation_docs(spark, sf).dropDuplicates(["path", "level"]).withColumns({
        "keywords": F.array("subfield", "year"), "summary": P.strip_space(F.col("text")),
        "word_count": F.regexp_count("text", F.lit(r"\S+"))})
    return genplan.generation_requests(rows).select("path", "level", F.md5("prompt").alias("digest"))


@query("M5_token_budget", f"""WITH {GEN} SELECT path, CAST(least(2000, floor(words * 1.5::DOUBLE)) AS INTEGER) AS budget,
 CAST(greatest(500, least(15000, floor(floor(words * 1.05::DOUBLE) * 1.33::DOUBLE * 1.1::DOUBLE))) AS INTEGER) AS news_budget FROM gd""")
def m5(spark, sf):
    d = generation_docs(spark, sf).where("level = 1").withColumn("w", F.regexp_count("text", F.lit(r"\S+")))
    return d.select("path", P.max_tokens(F.col("w")).alias("budget"), P.max_tokens(F.col("w"), news=True).alias("news_budget"))


@query("M7_metadata_block", f"WITH {GEN}, l AS (SELECT *, unnest([1, 2, 3]) AS level FROM gd) SELECT path, genre, subfield, year, 'LV' || level AS level, 'GEMMA_4B' AS model, genre || '_' || subfield || '_' || year || '_' || idx AS identifier FROM l")
def m7(spark, sf):
    r = genplan.extraction_requests(generation_docs(spark, sf), "GEMMA_4B").select("path", P.metadata_block(F.col("user_prompt")).alias("m"))
    return r.select("path", *[F.col("m")[k].alias(k) for k in ("genre", "subfield", "year", "level", "model", "identifier")])


def answers(spark, sf):
    """Model answers made from the messages, with the usual defects."""
    t = F.regexp_replace(F.col("text"), r'["\\{}\n]', " ")
    k = F.pmod(F.col("author_id") * 31 + F.col("item"), F.lit(8))
    body = F.concat(F.lit('{"keywords": [" Alpha ", "beta", "", "GAMMA"], "summary": "'), t, F.lit('", "word_count": '), F.length("text").cast("string"), F.lit("}"))
    return message_texts(spark, sf).withColumn("kind", k.cast("int")).withColumn("answer", (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure! "), body, F.lit(" Hope this helps {x}")))
        .when(k == 3, F.regexp_replace(body, r" \d+\}$", "")).when(k == 4, F.concat(F.lit('{"keywords": "One, two ,", "summary": "'), t))
        .when(k == 5, F.lit("  ")).when(k == 6, F.lit("no answer here")).otherwise("Meta moderation {}")))


ANSWERS = f"""{MESSAGES_SQL}, an AS (SELECT author_id, item, CAST((author_id * 31 + item) % 8 AS INTEGER) AS kind, text,
   regexp_replace(regexp_replace(text, '["\\\\{{}}\n]', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS s FROM msgs)"""


@query("M8_repair_answers", f"""WITH {ANSWERS} SELECT author_id, item, kind, CASE WHEN kind = 4 THEN 'one|two' ELSE 'alpha|beta|gamma' END AS keywords, md5(s) AS summary_digest,
 CASE WHEN kind < 3 THEN CAST(length(text) AS VARCHAR) WHEN kind = 3 THEN '0' END AS word_count FROM an WHERE kind < 5""")
def m8(spark, sf):
    good, _ = genplan.parse_answers(answers(spark, sf), ["author_id", "item", "kind"])
    return good.select("author_id", "item", "kind", F.array_join("keywords", "|").alias("keywords"), F.md5("summary").alias("summary_digest"), "word_count")


@query("M8_rejected_answers", f"WITH {ANSWERS} SELECT CASE kind WHEN 5 THEN 'empty response' WHEN 6 THEN 'no object found' ELSE 'moderation flag' END AS reason, count(*) AS n FROM an WHERE kind >= 5 GROUP BY 1")
def m8r(spark, sf):
    _, bad = genplan.parse_answers(answers(spark, sf), ["author_id", "item"])
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("M9_normal_keywords", f"""WITH {MESSAGES_SQL}, k AS (SELECT author_id, item, list_filter(list_transform(string_split(text, ' '), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '')[1:5] AS k FROM msgs)
 SELECT author_id, item, array_to_string(k, '|') AS keywords FROM k""")
def m9(spark, sf):
    return message_texts(spark, sf).select("author_id", "item", F.array_join(P.normal_keywords(F.split("text", " ")), "|").alias("keywords"))


@query("M10_normal_word_count", f"""WITH {MESSAGES_SQL} SELECT author_id, item, CAST(CASE WHEN item % 3 = 0 AND author_id > 0 THEN author_id ELSE len(regexp_extract_all(text, '\\S+')) END AS INTEGER) AS word_count FROM msgs""")
def m10(spark, sf):
    raw = F.when(F.col("item") % 3 == 0, F.col("author_id").cast("string")).when(F.col("item") % 3 == 1, "many")
    return message_texts(spark, sf).select("author_id", "item", P.normal_word_count(raw, F.col("text")).alias("word_count"))


TASK = "(" + " OR ".join(f"contains(lower(x), {_sql_text(p)})" for p in P.TASK_PHRASES) + ")"
CUT = "list_filter(string_split(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '')"


@query("M11_fallback_summary", f"""WITH {MESSAGES_SQL}, a AS (SELECT author_id, item, text, CASE item % 3 WHEN 0 THEN 'Your task is done. ' || text WHEN 1 THEN 'Not applicable.' ELSE text END AS ans FROM msgs),
 s AS (SELECT *, {CUT.format(c='ans')} AS sa, {CUT.format(c='text')} AS so FROM a),
 b AS (SELECT author_id, item, coalesce(list_filter(sa, lambda x: NOT {TASK})[1], so[1], sa[1], '') AS best FROM s)
 SELECT author_id, item, array_to_string(string_split(best, ' ')[1:30], ' ') AS summary FROM b""")
def m11(spark, sf):
    t = F.col("text")
    ans = F.when(F.col("item") % 3 == 0, F.concat(F.lit("Your task is done. "), t)).when(F.col("item") % 3 == 1, "Not applicable.").otherwise(t)
    return message_texts(spark, sf).select("author_id", "item", P.fallback_summary(ans, t).alias("summary"))


@query("M12_flagged_outputs", "SELECT lang, source, count(*) FILTER (contains(text, 'the')) AS flagged, count(*) AS total FROM documents GROUP BY ALL")
def m12(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return genplan.flag_report(docs, "the", ["lang", "source"])


SOURCES = f"""fm AS (SELECT id, coalesce(nullif(regexp_extract(path, '{N.FLAGGED_DIR}', 1), ''), regexp_extract({BASE}, '{N.FLAGGED_NAME}', 1)) AS period,
   coalesce(nullif(regexp_extract(path, '{N.FLAGGED_DIR}', 2), ''), regexp_extract({BASE}, '{N.FLAGGED_NAME}', 3)) AS year, regexp_extract({BASE}, '{N.FLAGGED_NAME}', 4) AS idx
   FROM fp WHERE regexp_matches({BASE}, '{N.FLAGGED_NAME}')),
 src AS (SELECT period, year, idx, period || '_' || printf('%02d', id % 7) || '_' || year || '_' || idx || '.txt' AS path FROM fm WHERE id % 4 <> 1)"""


@query("D14_source_of_flagged_output", f"{W}, {FLAG_PATHS}, {SOURCES} SELECT fm.*, s.p AS source_path FROM fm LEFT JOIN (SELECT period, year, idx, min(path) AS p FROM src GROUP BY ALL) s USING (period, year, idx)")
def d14(spark, sf):
    fm = flagged_paths(spark, sf).select("id", N.flagged_meta(F.col("path")).alias("m")).where("m IS NOT NULL").select("id", "m.period", "m.year", "m.idx")
    src = fm.where(F.col("id") % 4 != 1).select("period", "year", "idx", F.concat(F.concat_ws(
        "_", "period", F.format_string("%02d", F.col("id") % 7), "year", "idx"), F.lit(".txt")).alias("path"))
    return genplan.flagged_sources(fm, src)


@query("M14_run_statistics", f"""{W}, {EXPECTED} SELECT level, count(*) FILTER (md5(filename)[1] >= '6' AND md5(filename)[2] <> '0') AS processed, count(*) FILTER (md5(filename)[1] < '6') AS skipped,
 count(*) FILTER (md5(filename)[1] >= '6' AND md5(filename)[2] = '0') AS failed FROM ex GROUP BY 1""")
def m14(spark, sf):
    h = F.md5("filename")
    status = F.when(F.substring(h, 1, 1) < "6", "skipped").when(F.substring(h, 2, 1) == "0", "failed").otherwise("processed")
    return genplan.run_statistics(expected(spark, sf).withColumn("status", status), ["processed", "skipped", "failed"])


@query("E26_length_compliance", f"""WITH {MESSAGES_SQL}, p AS (SELECT label, len(regexp_extract_all(text, '\\S+')) AS actual, CAST(length(text) // 6 AS INTEGER) AS target FROM msgs),
 d AS (SELECT label, coalesce(abs(actual - target) * 100.0::DOUBLE / nullif(target, 0), 0) AS d FROM p)
 SELECT label, count(*) AS total, count(*) FILTER (d <= 5) AS within_5pct, count(*) FILTER (d <= 10) AS within_10pct, round(avg(d), 7) AS avg_diff, round(list_sort(list(d))[count(*) // 2 + 1], 7) AS median_diff FROM d GROUP BY 1""")
def e26(spark, sf):
    w = message_texts(spark, sf).select(
        "label", F.regexp_count("text", F.lit(r"\S+")).alias("actual"), F.floor(F.length("text") / 6).alias("target"))
    return rounded(report.length_compliance(w, ["label"], "actual", "target"), 7)
