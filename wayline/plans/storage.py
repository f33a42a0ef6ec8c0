"""Queries that write a table derived from the inputs and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions import features as feat
from wayline.functions.columns import rounded
from wayline.plans.registry import query
from wayline.plans.trajectory import K4, KEYS4
from wayline.plans.trends import DIFF, differences
from wayline.sources import corpus, tables
from wayline.sources.bindings import DOCS_SQL, YEARS_SQL, document_texts, message_texts, supplier_years, table


def conversation_files(spark, sf):
    """One text file per conversation, messages in turn order."""
    out = tables.scratch(spark, "texts")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    # a conversation goes to one file; the file name carries the conversation id
    c.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "text").write.partitionBy("conv_id").text(out)
    return out


@query("A1_text_corpus_scan", """SELECT conv_id, length(t) AS chars, md5(t) AS digest FROM
 (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY 1)""")
def a1(spark, sf):
    files = corpus.scan_texts(spark, conversation_files(spark, sf))
    return files.select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("bigint").alias("conv_id"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("A2_encoding_fallback", f"WITH {DOCS_SQL} SELECT domain, count(*) AS n, count(*) FILTER (length(text) > 0) AS readable, CAST(sum(length(text)) AS BIGINT) AS chars FROM docs GROUP BY 1")
def a2(spark, sf):
    """Every second document is stored as Latin-1 bytes, the others as UTF-8."""
    d = document_texts(spark, sf)
    latin = F.encode(F.col("text"), "ISO-8859-1")
    fits = F.decode(latin, "ISO-8859-1") == F.col("text")
    content = F.when((F.col("doc_id") % 2 == 0) & fits, latin).otherwise(F.encode("text", "UTF-8"))
    t = d.select("domain", corpus.decode_text(content).alias("text"))
    return t.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 0).alias("readable"), F.sum(F.length("text")).alias("chars"))


@query("A4_whole_text", f"WITH {DOCS_SQL} SELECT domain, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (length(text) > 8000) AS longer_than_8000 FROM docs GROUP BY 1")
def a4(spark, sf):
    """Texts are processed whole; how many a limit of 8,000 characters would have cut."""
    d = document_texts(spark, sf)
    return d.groupBy("domain").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") > 8000).alias("longer_than_8000"))


def split_layout(spark, sf):
    """Supplier years written as label/model/level/domain folders."""
    out = tables.scratch(spark, "splits")
    y = supplier_years(spark, sf).withColumns({
        "label": F.when(F.col("model") == "N", "human").otherwise("llm"), "level": F.concat(F.lit("LV"), (F.pmod("author_id", F.lit(3)) + 1).cast("string"))})
    tables.write_splits(y, out)
    return out, y.schema


@query("A5_partitioned_scan", f"WITH {YEARS_SQL} SELECT domain, model, count(*) AS n, round(avg(tax), 9) AS tax FROM f1 WHERE model <> 'N' AND author_id % 3 = 2 AND domain IN ('ASIA', 'EUROPE') GROUP BY ALL")
def a5(spark, sf):
    out, schema = split_layout(spark, sf)
    where = (F.col("label") == "llm") & (F.col("level") == "LV3") & F.col("domain").isin("ASIA", "EUROPE")
    return rounded(tables.read_splits(spark, out, schema, where).groupBy("domain", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("tax").alias("tax")), 9)


@query("A6_first_existing_path", f"WITH {YEARS_SQL} SELECT model, count(*) AS n FROM f1 GROUP BY 1")
def a6(spark, sf):
    out, schema = split_layout(spark, sf)
    root = tables.first_existing(spark, [out + "-masked", out + "-merged", out])
    return tables.read_splits(spark, root, schema).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("A7_split_sink", f"WITH {YEARS_SQL} SELECT CASE WHEN model = 'N' THEN 'human' ELSE 'llm' END AS label, model, 'LV' || (1 + author_id % 3) AS level, domain, count(*) AS n FROM f1 GROUP BY ALL")
def a7(spark, sf):
    out, schema = split_layout(spark, sf)
    return tables.read_splits(spark, out, schema).groupBy(*tables.SPLIT).agg(F.count(F.lit(1)).alias("n"))


@query("A8_csv_table", f"WITH {YEARS_SQL} SELECT {K4}, year, round(discount, 7) AS discount, round(price, 6) AS price FROM f1")
def a8(spark, sf):
    out = tables.scratch(spark, "csv")
    y = rounded(rounded(supplier_years(spark, sf).select("price", "discount", "year", *KEYS4), 7, "discount"), 6, "price")
    tables.write_csv(y, out, [*KEYS4, "year"], ["field", "author_id"])
    cols = tables.ordered_columns(y, [*KEYS4, "year"])
    schema = T.StructType([y.schema[c] for c in cols])
    return spark.read.schema(schema).option("header", True).csv(out)


def nested(spark, sf):
    out = tables.scratch(spark, "json")
    d = rounded(differences(spark, sf), 5)
    tables.write_nested_json(d, out, ["domain", "feature", "model"], ["year", "difference"], "yearly")
    return out, d


NESTED = T.StructType([T.StructField(c, T.StringType()) for c in ("domain", "feature", "model")] + [
    T.StructField("yearly", T.ArrayType(T.StructType([T.StructField("year", T.IntegerType()), T.StructField("difference", T.DoubleType())])))])


@query("A9_nested_json_sink", f"WITH {DIFF} SELECT domain, feature, model, count(*) AS n_years, min(year) AS first_year FROM df GROUP BY ALL")
def a9(spark, sf):
    out, _ = nested(spark, sf)
    y = F.col("yearly")
    return spark.read.schema(NESTED).json(out).select(
        "domain", "feature", "model", F.size(y).cast("bigint").alias("n_years"), y[0]["year"].alias("first_year"))


@query("A10_nested_json_source", f"WITH {DIFF} SELECT domain, feature, model, year, round(difference, 5) + 0.0 AS difference FROM df")
def a10(spark, sf):
    out, _ = nested(spark, sf)
    return tables.read_nested_json(spark, out, NESTED, ["domain", "feature", "model"], "yearly")


@query("A11_append_log", "SELECT 'doc_' || doc_id AS sample, lang AS model, CASE WHEN doc_id % 4 = 0 THEN 'UNKNOWN' ELSE source END AS level FROM documents")
def a11(spark, sf):
    out = tables.scratch(spark, "log")
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("sample"), F.col("lang").alias("model"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("level"))
    for part in (d.where(F.pmod(F.xxhash64("sample"), F.lit(2)) == 0), d.where(F.pmod(F.xxhash64("sample"), F.lit(2)) == 1)):
        tables.append_log(part, out, ["model", "level", "sample"])
    return tables.read_log(spark, out, ["sample", "model", "level"]).drop("ts")


@query("A12_document_sink", "SELECT role AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT CASE role WHEN 'user' THEN 'human' ELSE 'llm' END AS role, text FROM conversations WHERE role <> 'system') GROUP BY 1")
def a12(spark, sf):
    out = tables.scratch(spark, "documents")
    m = message_texts(spark, sf).select("label", F.format_string("conv_%d_%02d.txt", "author_id", "item").alias("filename"), "text")
    corpus.write_texts(m, out, ["label"])
    back = spark.read.schema("filename string, text string, label string").parquet(out)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("A13_header_strip", "SELECT r_regionkey, r_name FROM region")
def a13(spark, sf):
    r = table(spark, sf, "region")
    return feat.strip_headers(r.toDF(*[f" {c}  " for c in r.columns]))


@query("A14_text_semi_join", "SELECT doc_id, quality FROM labels WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1)")
def a14(spark, sf):
    path = F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = table(spark, sf, "labels").withColumn("path", F.when(F.col("doc_id") % 5 != 0, path).otherwise("  "))
    texts = table(spark, sf, "documents").where("doc_id % 3 <> 1").select(path.alias("path"))
    return corpus.with_existing_text(rows, texts).select("doc_id", "quality")
