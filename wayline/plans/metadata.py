"""Queries for the metadata operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import names as N
from wayline.plans.registry import query
from wayline.sources.bindings import NAMES_SQL, corpus_names

META = ["domain", "field", "author_id", "year", "item_index", "model", "level"]
W = "WITH " + NAMES_SQL
EXT = "CASE WHEN filename LIKE '%.txt' THEN filename ELSE filename || '.txt' END"


def _expand(df, struct, fields, keep=("id",)):
    return df.select(*keep, struct.alias("_m")).select(*keep, *[F.col(f"_m.{f}").alias(f) for f in fields])


def _name_sql(pattern: str, with_model: bool) -> str:
    tail = (
        f", regexp_extract(n, '{pattern}', 6) AS model, regexp_extract(n, '{pattern}', 7) AS level"
        if with_model else ", NULL::VARCHAR AS model, NULL::VARCHAR AS level"
    )
    return (
        f"SELECT id, n, lower(regexp_extract(n, '{pattern}', 1)) AS domain, regexp_extract(n, '{pattern}', 2) AS field, "
        f"regexp_extract(n, '{pattern}', 3) AS author_id, regexp_extract(n, '{pattern}', 4) AS year, "
        f"regexp_extract(n, '{pattern}', 5) AS item_index{tail} FROM nm WHERE regexp_matches(n, '{pattern}')"
    )


NM = W + f", nm AS (SELECT id, path, {EXT} AS n FROM names)"
HUMAN_PART, MODEL_PART = _name_sql(N.HUMAN_NAME, False), _name_sql(N.MODEL_NAME, True)
COLS = ", ".join(f"m.{c}" for c in META)
NAME_SQL = NM + ", m AS ({part}) SELECT nm.id, " + COLS + " FROM nm LEFT JOIN m USING (id)"


@query("B1_parse_human_filename", NAME_SQL.replace("{part}", HUMAN_PART))
def b1(spark, sf):
    return _expand(corpus_names(spark, sf), N.human_name(F.col("filename")), META)


@query("B2_parse_model_filename", NAME_SQL.replace("{part}", MODEL_PART))
def b2(spark, sf):
    return _expand(corpus_names(spark, sf), N.model_name(F.col("filename")), META)


BOTH = f"{HUMAN_PART} UNION ALL {MODEL_PART} AND NOT regexp_matches(n, '{N.HUMAN_NAME}')"


@query("B3_parse_any_filename", NAME_SQL.replace("{part}", BOTH))
def b3(spark, sf):
    return _expand(corpus_names(spark, sf), N.any_name(F.col("filename")), META)


@query("B4_path_metadata", W + f""", p AS (
  SELECT id, path, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS fn FROM names),
 a AS (SELECT *, CASE WHEN list_contains(parts, 'Human') THEN list_position(parts, 'Human')
       WHEN list_contains(parts, 'cleaned_human') THEN list_position(parts, 'cleaned_human')
       WHEN list_contains(parts, 'human') THEN list_position(parts, 'human') END AS pos FROM p),
 b AS (SELECT *, parts[pos + 1] AS g, parts[pos + 2] AS s, regexp_matches(fn, '{N.PATH_NAME}') AS hit FROM a)
SELECT id, CASE WHEN pos IS NULL THEN NULL ELSE lower(g) END AS genre,
  CASE WHEN pos IS NULL THEN NULL WHEN hit THEN lower(regexp_extract(fn, '{N.PATH_NAME}', 2)) ELSE coalesce(lower(s), 'unknown') END AS subfield,
  CASE WHEN pos IS NULL THEN NULL WHEN hit THEN regexp_extract(fn, '{N.PATH_NAME}', 3) ELSE '01' END AS batch,
  CASE WHEN pos IS NULL THEN NULL WHEN hit THEN regexp_extract(fn, '{N.PATH_NAME}', 4)
       WHEN regexp_matches(path, '\\d{{4}}') THEN regexp_extract(path, '(\\d{{4}})', 1) ELSE '0000' END AS year,
  CASE WHEN pos IS NULL THEN NULL WHEN hit THEN regexp_extract(fn, '{N.PATH_NAME}', 5) ELSE '01' END AS index
FROM b""")
def b4(spark, sf):
    return _expand(corpus_names(spark, sf), N.path_meta(F.col("path")), ["genre", "subfield", "batch", "year", "index"])


def _macro_sql(anchor: str, pattern: str, with_model: bool) -> str:
    g = lambda i: f"regexp_extract(fn, '{pattern}', {i})"
    tail = f"upper({g(5)})" if with_model else "NULL::VARCHAR", f"upper({g(6)})" if with_model else "NULL::VARCHAR"
    return f"""SELECT id, path,
  CASE WHEN err IS NULL THEN CASE WHEN lower({g(1)}) IN ('news', 'blogs', 'academic') THEN lower({g(1)}) ELSE lower(parts[pos + 1]) END END AS genre,
  CASE WHEN err IS NULL THEN lower({g(2)}) END AS subfield, CASE WHEN err IS NULL THEN '01' END AS batch,
  CASE WHEN err IS NULL THEN {g(3)} END AS year, CASE WHEN err IS NULL THEN {g(4)} END AS index,
  CASE WHEN err IS NULL THEN {tail[0]} END AS model, CASE WHEN err IS NULL THEN {tail[1]} END AS level, err AS error
 FROM (SELECT *, CASE WHEN pos IS NULL THEN 'no {anchor} directory' WHEN parts[pos + 1] IS NULL THEN 'unexpected path structure'
         WHEN NOT regexp_matches(fn, '{pattern}') THEN 'file name does not match the grammar' END AS err
       FROM (SELECT id, path, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS fn,
               CASE WHEN list_contains(string_split(path, '/'), '{anchor}') THEN list_position(string_split(path, '/'), '{anchor}') END AS pos
             FROM names))"""


MACRO = ["genre", "subfield", "batch", "year", "index", "model", "level", "error"]
MACRO_COLS = ", ".join(MACRO)


@query("B5_domain_human_path", W + ", x AS (" + _macro_sql("human", N.DOMAIN_HUMAN_NAME, False) + f") SELECT id, {MACRO_COLS} FROM x")
def b5(spark, sf):
    return _expand(corpus_names(spark, sf), N.domain_human_path(F.col("path")), MACRO)


@query("B5_quarantine_counts", W + ", x AS (" + _macro_sql("human", N.DOMAIN_HUMAN_NAME, False)
       + ") SELECT coalesce(error, 'ok') AS outcome, count(*) AS n FROM x GROUP BY 1")
def b5q(spark, sf):
    df = corpus_names(spark, sf).select("id", N.domain_human_path(F.col("path")).alias("m"))
    good, bad = N.quarantine(df, "m")
    return (
        good.select(F.lit("ok").alias("outcome")).unionByName(bad.select(F.col("m.error").alias("outcome")))
        .groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    )


@query("B6_domain_model_path", W + ", x AS (" + _macro_sql("llm", N.DOMAIN_MODEL_NAME, True) + f") SELECT id, {MACRO_COLS} FROM x")
def b6(spark, sf):
    return _expand(corpus_names(spark, sf), N.domain_model_path(F.col("path")), MACRO)


BASE = "string_split(path, '/')[-1]"


@query("B7_metadata_dispatch", W + ", x AS (" + _macro_sql("human", N.DOMAIN_HUMAN_NAME, False) + f"""),
 nm AS (SELECT id, path, CASE WHEN {BASE} LIKE '%.txt' THEN {BASE} ELSE {BASE} || '.txt' END AS n FROM names),
 m AS ({BOTH}),
 j AS (SELECT nm.id, list_contains(string_split(nm.path, '/'), 'macro_dataset') AND x.error IS NULL AS mac, x.genre, x.subfield, x.batch,
         x.year AS xy, x.index, {COLS} FROM nm JOIN x USING (id) LEFT JOIN m USING (id))
 SELECT id, CASE WHEN mac THEN genre ELSE domain END AS domain, CASE WHEN mac THEN subfield ELSE field END AS field,
  CASE WHEN mac THEN batch ELSE author_id END AS author_id, CASE WHEN mac THEN xy ELSE year END AS year,
  CASE WHEN mac THEN index ELSE item_index END AS item_index, CASE WHEN NOT mac THEN model END AS model,
  CASE WHEN NOT mac THEN level END AS level FROM j""")
def b7(spark, sf):
    return _expand(corpus_names(spark, sf), N.dispatch_meta(F.col("path"), is_model=False), META)


AUTHOR_SQL = f"""au AS (
 SELECT id, 'llm' AS label, CAST(regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 4) AS INTEGER) AS year,
   regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 6) AS provider, CAST(regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 7) AS INTEGER) AS level,
   regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 6) || '_LV' || regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 7) || '_' || regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 1)
     || '_' || regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 2) || '_' || regexp_extract(fn, '{N.AUTHOR_KEY_MODEL}', 3) AS author
 FROM (SELECT id, {BASE} AS fn FROM names) WHERE regexp_matches(fn, '{N.AUTHOR_KEY_MODEL}')
 UNION ALL
 SELECT id, 'human', CAST(regexp_extract(fn, '{N.AUTHOR_KEY_HUMAN}', 4) AS INTEGER), 'human', 0,
   'human_' || regexp_extract(fn, '{N.AUTHOR_KEY_HUMAN}', 1) || '_' || regexp_extract(fn, '{N.AUTHOR_KEY_HUMAN}', 2) || '_' || regexp_extract(fn, '{N.AUTHOR_KEY_HUMAN}', 3)
 FROM (SELECT id, {BASE} AS fn FROM names) WHERE regexp_matches(fn, '{N.AUTHOR_KEY_HUMAN}'))"""


@query("B8_composite_author_key", W + ", " + AUTHOR_SQL + " SELECT * FROM au")
def b8(spark, sf):
    df = _expand(corpus_names(spark, sf), N.composite_author(F.col("path")), ["label", "year", "provider", "level", "author"])
    return df.where(F.col("author").isNotNull())


@query("B9_split_author_key", W + ", " + AUTHOR_SQL + """,
 k AS (SELECT id, author FROM au UNION ALL SELECT -id - 1, genre || '_' || subfield || '_' || batch FROM names),
 p AS (SELECT id, string_split(author, '_') AS p FROM k),
 s AS (SELECT *, p[1] IN ('DS', 'G4B', 'G12B', 'LMK') AS is_llm,
         CASE WHEN p[1] IN ('DS', 'G4B', 'G12B', 'LMK') THEN 2 WHEN p[1] = 'human' THEN 1 ELSE 0 END AS o FROM p)
 SELECT id, CASE WHEN is_llm THEN p[1] END AS model, CASE WHEN is_llm THEN TRY_CAST(replace(p[2], 'LV', '') AS INTEGER) END AS level,
   lower(p[o + 1]) AS domain, p[o + 2] AS field, CASE WHEN regexp_matches(p[o + 3], '^\\d+$') THEN TRY_CAST(p[o + 3] AS INTEGER) END AS author_id,
   is_llm FROM s""")
def b9(spark, sf):
    names = corpus_names(spark, sf)
    built = names.select("id", N.composite_author(F.col("path"))["author"].alias("author")).where(F.col("author").isNotNull())
    bare = names.select((-F.col("id") - 1).alias("id"), F.concat_ws("_", "genre", "subfield", "batch").alias("author"))
    return _expand(built.unionByName(bare), N.split_author(F.col("author")),
                   ["model", "level", "domain", "field", "author_id", "is_llm"])


@query("B10_token_metadata", W + """, p AS (SELECT id, string_split(replace(filename, '.txt', ''), '_') AS p FROM names)
 SELECT id, CASE WHEN len(p) >= 5 THEN lower(p[1]) END AS domain, CASE WHEN len(p) >= 5 THEN p[2] END AS field,
  CASE WHEN len(p) >= 5 THEN p[3] END AS author_id, CASE WHEN len(p) >= 5 AND regexp_matches(p[4], '^\\d{4}$') THEN p[4] END AS year,
  CASE WHEN len(p) >= 5 AND regexp_matches(p[5], '^\\d+$') THEN p[5] END AS item_index,
  CASE WHEN len(p) >= 7 THEN p[6] END AS model, CASE WHEN len(p) >= 7 THEN p[7] END AS level FROM p""")
def b10(spark, sf):
    return _expand(corpus_names(spark, sf), N.token_meta(F.col("filename")), META)


@query("B11_first_year_token", W + """ SELECT id,
 CAST(list_filter(string_split(filename, '_'), lambda t: regexp_matches(t, '^[0-9]{4}$'))[1] AS INTEGER) AS year FROM names""")
def b11(spark, sf):
    return corpus_names(spark, sf).select("id", N.first_year_token(F.col("filename")).alias("year"))


@query("B12_first_year_run", W + """ SELECT id, CAST(nullif(regexp_extract(filename, '(\\d{4})', 1), '') AS INTEGER) AS year,
 CAST(nullif(regexp_extract(filename, '_(\\d{4})_', 1), '') AS INTEGER) AS year_delimited FROM names""")
def b12(spark, sf):
    f = F.col("filename")
    return corpus_names(spark, sf).select("id", N.first_year_run(f).alias("year"), N.first_year_run(f, True).alias("year_delimited"))


@query("B13_year_and_index", W + """ SELECT id, CAST(nullif(regexp_extract(filename, '(\\d{4})_(\\d{2,})', 1), '') AS INTEGER) AS year,
 CAST(nullif(regexp_extract(filename, '(\\d{4})_(\\d{2,})', 2), '') AS INTEGER) AS item_index FROM names""")
def b13(spark, sf):
    return _expand(corpus_names(spark, sf), N.year_and_index(F.col("filename")), ["year", "item_index"])


TAG_SQL = ("CASE provider WHEN 'DEEPSEEK' THEN 'DS' WHEN 'GEMMA_4B' THEN 'G4B' WHEN 'GEMMA_12B' THEN 'G12B' "
           "WHEN 'LLAMA_MAVRICK' THEN 'LMK' ELSE 'DS' END")
FIELD_SQL = "CASE WHEN genre IN ('blogs', 'academic') THEN upper(subfield) ELSE lower(subfield) END"
CAP_SQL = "upper(genre[1]) || lower(genre[2:])"


@query("B14_build_filename", W + f""" SELECT id,
 {CAP_SQL} || '_' || {FIELD_SQL} || '_' || batch || '_' || year || '_' || index || '_' || {TAG_SQL}
   || CASE WHEN level > 0 THEN '_LV' || level ELSE '' END || '.txt' AS filename,
 {CAP_SQL} || '_' || {FIELD_SQL} || '_' || year || '_' || index || '_' || {TAG_SQL} || '_LV' || level || '.txt' AS domain_filename
 FROM names""")
def b14(spark, sf):
    c = F.col
    return corpus_names(spark, sf).select(
        "id",
        N.build_name(c("genre"), c("subfield"), c("batch"), c("year"), c("index"), c("level"), c("provider")).alias("filename"),
        N.build_domain_name(c("genre"), c("subfield"), c("year"), c("index"), c("level"), c("provider")).alias("domain_filename"),
    )


@query("B15_provider_tag", W + f" SELECT {TAG_SQL} AS tag, count(*) AS n FROM names GROUP BY 1")
def b15(spark, sf):
    return corpus_names(spark, sf).groupBy(N.provider_tag(F.col("provider")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("M6_identifier_label", W + f""" SELECT id, {CAP_SQL} || '_' || subfield || '_' || year ||
  CASE WHEN id % 4 = 0 THEN '' ELSE '_' || index END AS identifier FROM names""")
def m6(spark, sf):
    df = corpus_names(spark, sf).withColumn("index", F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("index")))
    return df.select("id", N.identifier(F.col("genre"), F.col("subfield"), F.col("year"), F.col("index")).alias("identifier"))


FLAG_PATHS = """fp AS (SELECT id, CASE id % 3 WHEN 0 THEN 'data/News/' || (id % 9) || '_years/' || year || '/' ELSE 'data/old/' END
  || 'News_' || subfield || '_y_LMK_LV' || (1 + id % 3) || '_' || CASE id % 5 WHEN 0 THEN '2050' ELSE year END || '_' || printf('%02d', id % 120) || '.txt' AS path FROM names)"""


@query("M13_flagged_name", W + ", " + FLAG_PATHS + f""", m AS (SELECT id, path, {BASE} AS fn FROM fp)
 SELECT id, coalesce(nullif(regexp_extract(path, '{N.FLAGGED_DIR}', 1), ''), regexp_extract(fn, '{N.FLAGGED_NAME}', 1)) AS period,
  coalesce(nullif(regexp_extract(path, '{N.FLAGGED_DIR}', 2), ''), regexp_extract(fn, '{N.FLAGGED_NAME}', 3)) AS year,
  regexp_extract(fn, '{N.FLAGGED_NAME}', 4) AS idx, CAST(regexp_extract(fn, '{N.FLAGGED_NAME}', 2) AS INTEGER) AS level
 FROM m WHERE regexp_matches(fn, '{N.FLAGGED_NAME}')""")
def m13(spark, sf):
    return _expand(flagged_paths(spark, sf), N.flagged_meta(F.col("path")), ["period", "year", "idx", "level"]).where("period is not null")


def flagged_paths(spark, sf):
    k = F.col("id")
    return corpus_names(spark, sf).select("id", F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("data/News/"), (k % 9).cast("string"), F.lit("_years/"), F.col("year"), F.lit("/"))).otherwise("data/old/"),
        F.lit("News_"), F.col("subfield"), F.lit("_y_LMK_LV"), (k % 3 + 1).cast("string"), F.lit("_"),
        F.when(k % 5 == 0, "2050").otherwise(F.col("year")), F.lit("_"), F.format_string("%02d", k % 120), F.lit(".txt"),
    ).alias("path"))
