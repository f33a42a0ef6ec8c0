"""Bindings of the star-schema tables to the trajectory data model.

Each binding has a DataFrame form and the same relation as a SQL common table
expression (``*_SQL``), which the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayline.functions import names as N


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """An input table; its schema is read from the files once in a process, which saves a job for every further query."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


FEATURES = ["quantity", "price", "discount", "tax"]

# F1 ------------------------------------------------------------------ suppliers


def supplier_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as observations of a supplier (author) in a year."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("field"), F.col("l_suppkey").alias("author_id"),
        F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )
    return li


def with_supplier_domain(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """Add the region name of ``author_id``."""
    dim = (
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("author_id"), "s_nationkey")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("author_id", F.col("r_name").alias("domain"))
    )
    return df.join(dim, "author_id")


def supplier_year_means(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly feature means per (field, author, model); the domain follows from the author."""
    return supplier_items(spark, sf).groupBy("field", "author_id", "model", "year").agg(
        *[F.avg(f).alias(f) for f in FEATURES], F.count(F.lit(1)).alias("n")
    )


def supplier_years(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly feature means per (domain, field, author, model); aggregated below the join."""
    return with_supplier_domain(spark, sf, supplier_year_means(spark, sf))


ITEMS_SQL = """items AS (
  SELECT r_name AS domain, l_linestatus AS field, l_suppkey AS author_id, l_returnflag AS model,
         CAST(year(l_shipdate) AS INTEGER) AS year,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

YEARS_SQL = ITEMS_SQL + """, f1 AS (
  SELECT domain, field, author_id, model, year, avg(quantity) AS quantity, avg(price) AS price,
         avg(discount) AS discount, avg(tax) AS tax, count(*) AS n
  FROM items GROUP BY ALL)"""

LONG_SQL = YEARS_SQL + """, f1l AS (
  SELECT domain, field, author_id, model, year, 'quantity' AS feature, quantity AS value FROM f1 UNION ALL
  SELECT domain, field, author_id, model, year, 'price', price FROM f1 UNION ALL
  SELECT domain, field, author_id, model, year, 'discount', discount FROM f1 UNION ALL
  SELECT domain, field, author_id, model, year, 'tax', tax FROM f1)"""

# F2 -------------------------------------------------------------------- orders


def order_series(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a customer's time series, ordered by (year, o_orderkey)."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("field"),
        F.col("o_orderstatus").alias("model"), F.year("o_orderdate").alias("year"),
        F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("value"),
    )
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_mktsegment").alias("domain"))
    return o.join(c, "author_id")


ORDERS_SQL = """f2 AS (
  SELECT o_custkey AS author_id, c_mktsegment AS domain, o_orderpriority AS field, o_orderstatus AS model,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS item, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# F3 -------------------------------------------------------------------- events


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a user's series per type; the day cuts a series into blocks."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("author_id"), F.col("event_type").alias("field"),
        "ts", F.col("event_id").alias("item"), "value", F.to_date("ts").alias("day"),
    )


EVENTS_SQL = """f3 AS (
  SELECT user_id AS author_id, event_type AS field, ts, event_id AS item, value, CAST(ts AS DATE) AS day FROM events)"""

# F4 ------------------------------------------------------------------ documents


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", "text", F.col("lang").alias("domain"), F.col("source").alias("author_id"),
        (F.lit(2000) + F.pmod(F.floor(F.col("doc_id") / 20), F.lit(5))).cast("int").alias("year"),
    )


DOCS_SQL = """docs AS (
  SELECT doc_id, text, lang AS domain, source AS author_id,
         CAST(2000 + (doc_id // 20) % 5 AS INTEGER) AS year FROM documents)"""

# F5 -------------------------------------------------------------- conversations


def message_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation messages: user = human side, assistant = model side."""
    return (
        table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
        .select(
            F.col("conv_id").alias("author_id"), F.col("turn").alias("item"),
            F.when(F.col("role") == "user", "human").otherwise("llm").alias("label"), "text",
        )
    )


MESSAGES_SQL = """msgs AS (
  SELECT conv_id AS author_id, turn AS item, CASE WHEN role = 'user' THEN 'human' ELSE 'llm' END AS label, text
  FROM conversations WHERE role IN ('user', 'assistant'))"""

# F6 ----------------------------------------------------------------- embeddings


def vector_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("author_id"), F.col("vec_id").alias("item"),
        F.pmod(F.col("vec_id"), F.lit(7)).cast("int").alias("year"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


VECTORS_SQL = """vecs AS (
  SELECT label AS author_id, vec_id AS item, CAST(vec_id % 7 AS INTEGER) AS year,
         CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""

# names ------------------------------------------------------- synthesised from F2


def corpus_names(spark: SparkSession, sf: str) -> DataFrame:
    """One file name and path per order; a share of them breaks the grammar in a known way."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("id")
    dom, seg, y, cust, idx = (F.col(c) for c in ("dom", "seg", "year", "batch", "index"))
    parts = o.select(
        F.col("o_orderkey").alias("id"),
        F.element_at(F.array(F.lit("News"), F.lit("Blogs"), F.lit("Academic")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("dom"),
        F.col("c_mktsegment").alias("seg"), F.year("o_orderdate").cast("string").alias("year"),
        F.format_string("%02d", F.col("o_custkey")).alias("batch"),
        F.format_string("%02d", F.col("o_orderkey") % 130).alias("index"),
        F.element_at(F.array(*[F.lit(p) for p in [*N.MODEL_TAGS, "OTHER"]]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("provider"),
        (F.col("o_orderkey") % 4).cast("int").alias("level"),
    ).withColumns({
        "base": F.concat_ws("_", dom, seg, cust, y, idx),
        "short": F.concat_ws("_", dom, seg, y, idx),
    })
    base, short, filename = F.col("base"), F.col("short"), F.col("filename")
    named = parts.withColumn(
        "filename",
        F.when(k % 7 == 0, F.concat(base, F.lit(".txt")))
        .when(k % 7 == 1, F.concat(base, F.lit("_DS_LV1.txt")))
        .when(k % 7 == 2, F.concat(base, F.lit("_G4B_lv2.txt")))
        .when(k % 7 == 3, F.concat(F.concat_ws("_", dom, seg, cust, F.lit("99"), idx), F.lit(".txt")))
        .when(k % 7 == 4, base)
        .when(k % 7 == 5, F.concat(F.concat_ws("_", dom, seg, F.lit("X"), cust, y, idx), F.lit(".txt")))
        .otherwise(F.concat(base, F.lit("_LMK_LV3.txt"))),
    )
    return named.select(
        "id", "filename",
        F.when(k % 6 == 0, F.concat(F.lit("data/Human/"), dom, F.lit("/"), filename))
        .when(k % 6 == 1, F.concat(F.lit("data/cleaned_human/Other/sub/"), filename))
        .when(k % 6 == 2, F.concat(F.lit("macro_dataset/human/"), F.lower(dom), F.lit("/"), short, F.lit(".txt")))
        .when(k % 6 == 3, F.concat(F.lit("macro_dataset/llm/"), F.lower(dom), F.lit("/"), short, F.lit("_G12B_LV2.txt")))
        .when(k % 6 == 4, F.concat(F.lit("macro_dataset/human/misc/Essay_"), filename))
        .otherwise(F.concat(F.lit("other/"), filename)).alias("path"),
        F.lower(dom).alias("genre"), F.lower(seg).alias("subfield"), "batch", "year", "index", "provider", "level",
    )


NAMES_SQL = """names AS (
  SELECT id, fn AS filename,
    CASE id % 6 WHEN 0 THEN 'data/Human/' || dom || '/' || fn
      WHEN 1 THEN 'data/cleaned_human/Other/sub/' || fn
      WHEN 2 THEN 'macro_dataset/human/' || lower(dom) || '/' || short || '.txt'
      WHEN 3 THEN 'macro_dataset/llm/' || lower(dom) || '/' || short || '_G12B_LV2.txt'
      WHEN 4 THEN 'macro_dataset/human/misc/Essay_' || fn
      ELSE 'other/' || fn END AS path,
    lower(dom) AS genre, lower(seg) AS subfield, cust AS batch, y AS year, idx AS "index", provider, level
  FROM (SELECT *, CASE id % 7 WHEN 0 THEN base || '.txt' WHEN 1 THEN base || '_DS_LV1.txt'
        WHEN 2 THEN base || '_G4B_lv2.txt' WHEN 3 THEN dom || '_' || seg || '_' || cust || '_99_' || idx || '.txt'
        WHEN 4 THEN base WHEN 5 THEN dom || '_' || seg || '_X_' || cust || '_' || y || '_' || idx || '.txt'
        ELSE base || '_LMK_LV3.txt' END AS fn
    FROM (SELECT *, dom || '_' || seg || '_' || cust || '_' || y || '_' || idx AS base,
                 dom || '_' || seg || '_' || y || '_' || idx AS short
      FROM (SELECT o_orderkey AS id, ['News', 'Blogs', 'Academic'][o_orderkey % 3 + 1] AS dom, c_mktsegment AS seg,
                   CAST(year(o_orderdate) AS VARCHAR) AS y, printf('%02d', o_custkey) AS cust,
                   printf('%02d', o_orderkey % 130) AS idx,
                   ['DEEPSEEK', 'GEMMA_4B', 'GEMMA_12B', 'LLAMA_MAVRICK', 'OTHER'][o_orderkey % 5 + 1] AS provider,
                   CAST(o_orderkey % 4 AS INTEGER) AS level
            FROM orders JOIN customer ON o_custkey = c_custkey))))"""
