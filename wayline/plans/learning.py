"""Queries for vectors, splits, models and metrics (J*, K*, L*, I14-I16, E16, E22, E25, E27, E33)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import features as feat
from wayline.functions.columns import rounded
from wayline.functions.text import FUNCTION_WORDS
from wayline.operators import batched, evaluate, geometry, knn, linear, models, report, split, store, tfidf
from wayline.plans.comparison import UNI, UNI_COLS, is_human, unified
from wayline.plans.registry import query
from wayline.plans.trajectory import K4, KEYS4
from wayline.plans.trends import normal_p_sql
from wayline.session import materialize
from wayline.sources.bindings import DOCS_SQL, FEATURES, YEARS_SQL, document_texts, supplier_years, table


STOPS = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)

# ---------------------------------------------------------------------- vectors

TFIDF_SQL = f"""{DOCS_SQL}, tk AS (SELECT domain, doc_id, unnest(regexp_extract_all(lower(text), '{tfidf.TERM}')) AS term FROM docs),
 tf AS (SELECT domain, doc_id, term, count(*) AS tf FROM tk WHERE term NOT IN ({STOPS}) GROUP BY ALL),
 nd AS (SELECT domain, count(*) AS n FROM docs GROUP BY 1),
 vo AS (SELECT domain, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY domain, term QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sum(tf) DESC, term) <= 20000),
 iw AS (SELECT vo.domain, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf, df FROM vo JOIN nd USING (domain)),
 w AS (SELECT domain, doc_id, term, tf * idf AS w FROM tf JOIN iw USING (domain, term)),
 nw AS (SELECT domain, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


def corpus(spark, sf):
    return document_texts(spark, sf).select("domain", "doc_id", "text")


def corpus_weights(spark, sf):
    return tfidf.tfidf(corpus(spark, sf), "domain", "doc_id", stop_words=FUNCTION_WORDS)


@query("J1_tfidf_weights", f"WITH {TFIDF_SQL} SELECT domain, doc_id, term, round(weight, 8) AS weight FROM nw")
def j1(spark, sf):
    return rounded(corpus_weights(spark, sf), 8)


@query("J1_weights_of_cut_texts", f"WITH {TFIDF_SQL.replace('lower(text)', 'lower(substring(text, 1, 8000))')} SELECT domain, doc_id, term, round(weight, 8) AS weight FROM nw")
def j1cut(spark, sf):
    """The optional cut of long texts (A4) before their terms are counted."""
    return rounded(tfidf.tfidf(corpus(spark, sf), "domain", "doc_id", stop_words=FUNCTION_WORDS, limit=8000), 8)


@query("J1_vocabulary", f"WITH {TFIDF_SQL} SELECT domain, term, df, round(idf, 8) AS idf FROM iw")
def j1v(spark, sf):
    lists = materialize(tfidf.term_lists(corpus(spark, sf), "domain", "doc_id", stop_words=FUNCTION_WORDS))
    return rounded(tfidf.vocabulary(lists, "domain"), 8)


def corpus_svd(spark, sf, k=10):
    rows, terms = tfidf.numbered_rows(corpus(spark, sf), "domain", "doc_id", "text", FUNCTION_WORDS, tfidf.MAX_FEATURES)
    return rows, tfidf.sparse_svd(rows, "domain", terms, k)


@query("J2_truncated_svd")
def j2(spark, sf):
    """Singular values per domain, next to the length of the score columns, which must equal them."""
    rows, svd = corpus_svd(spark, sf)
    total = tfidf.projected(rows, "domain", "doc_id", svd).select("domain", F.posexplode("vec").alias("component", "x")).groupBy("domain", "component").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("score_norm"))
    known = spark.createDataFrame([(d, i, float(s)) for d, v in svd.values.items() for i, s in enumerate(v)], "domain string, component int, singular_value double")
    return rounded(total.join(F.broadcast(known), ["domain", "component"]), 6)


@query("J2_svd_conditions", """SELECT lang AS domain, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS vectors, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS scores
 FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), range(10) a(i), range(10) b(j) WHERE i <= j""")
def j2c(spark, sf):
    """Products of right vectors, and of score columns over the product of their singular values: both are those of an orthonormal set."""
    rows, svd = corpus_svd(spark, sf)
    loadings = spark.createDataFrame([(d, [float(x) for x in r]) for d, v in svd.vectors.items() for r in v], "domain string, v array<double>")
    known = spark.createDataFrame([(d, [float(x) for x in s]) for d, s in svd.values.items()], "domain string, s array<double>")
    pairs = [(i, j) for i in range(10) for j in range(i, 10)]

    def products(df, name):
        sums = [F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"p{i}_{j}") for i, j in pairs]
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias(name)) for i, j in pairs])
        return df.groupBy("domain").agg(*sums).select("domain", F.inline(cells))

    scores = products(tfidf.projected(rows, "domain", "doc_id", svd).withColumnRenamed("vec", "v"), "scores").join(F.broadcast(known), "domain")
    scores = scores.select("domain", "i", "j", (F.col("scores") / (F.element_at("s", F.col("i") + 1) * F.element_at("s", F.col("j") + 1))).alias("scores"))
    return rounded(products(loadings, "vectors").join(scores, ["domain", "i", "j"]), 6)


def _power_sql(rounds=40):
    """The first singular value by repeated multiplication with the weights and their transpose."""
    out = f"WITH {TFIDF_SQL}, m AS MATERIALIZED (SELECT domain, doc_id, term, weight FROM nw), v0 AS MATERIALIZED (SELECT domain, term, 1.0::DOUBLE AS x FROM m GROUP BY ALL)"
    for i in range(rounds):
        out += f""", y{i} AS MATERIALIZED (SELECT m.domain, doc_id, sum(weight * x) AS y FROM m JOIN v{i} v ON m.domain = v.domain AND m.term = v.term GROUP BY ALL),
 z{i} AS (SELECT m.domain, term, sum(weight * y) AS z FROM m JOIN y{i} y ON m.doc_id = y.doc_id GROUP BY ALL), v{i + 1} AS MATERIALIZED (SELECT domain, term, z / sqrt(sum(z * z) OVER (PARTITION BY domain)) AS x, sqrt(sum(z * z) OVER (PARTITION BY domain)) AS n FROM z{i})"""
    return out + f" SELECT domain, round(sqrt(max(n)), 5) AS singular_value FROM v{rounds} GROUP BY 1"


@query("J2_first_singular_value", _power_sql())
def j2f(spark, sf):
    _, svd = corpus_svd(spark, sf, 1)
    return rounded(spark.createDataFrame([(d, float(v[0])) for d, v in svd.values.items()], "domain string, singular_value double"), 5)


@query("J3_domain_vectors_path")
def j3(spark, sf):
    vec = tfidf.domain_vectors(corpus(spark, sf), "domain", "doc_id", 10, stop_words=FUNCTION_WORDS)
    meta = document_texts(spark, sf).select("doc_id", "author_id", "year")
    yearly = geometry.yearly_vectors(vec.join(meta, "doc_id"), ["domain", "author_id", "year"])
    return rounded(geometry.path_metrics(yearly, ["domain", "author_id"], ["year"]), 6)


@query("J3_domain_vectors_norms", f"""WITH {TFIDF_SQL} SELECT domain, doc_id, round(sqrt(sum(weight * weight)), 6) AS length FROM nw GROUP BY ALL""")
def j3n(spark, sf):
    """The sparse rows that the decomposition reads have the weights' lengths."""
    rows, terms = tfidf.numbered_rows(corpus(spark, sf), "domain", "doc_id", "text", FUNCTION_WORDS, tfidf.MAX_FEATURES)
    return rounded(rows.where(F.size("at") > 0).select("domain", "doc_id", F.sqrt(F.aggregate("weight", F.lit(0.0), lambda a, x: a + x * x)).alias("length")), 6)


@query("J4_zscore", f"WITH {YEARS_SQL}, m AS (SELECT " + ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in FEATURES) + f" FROM f1) SELECT {K4}, year, " + ", ".join(
    f"round(({f} - {f}_m) / {f}_s, 7) + 0.0 AS {f}" for f in FEATURES) + " FROM f1, m")
def j4(spark, sf):
    return rounded(linear.zscore(supplier_years(spark, sf), FEATURES).select(*KEYS4, "year", *FEATURES), 7)


PAIRS = {"size": ("quantity", "price"), "rate": ("discount", "tax"), "mixed": ("price", "tax")}


@query("J5_pca_explained_variance", f"WITH {YEARS_SQL} " + " UNION ALL ".join(
    f"SELECT '{n}' AS features, round((1 + abs(corr({a}, {b}))) / 2, 7) AS pc1_share, round((1 - abs(corr({a}, {b}))) / 2, 7) AS pc2_share FROM f1" for n, (a, b) in PAIRS.items()))
def j5(spark, sf):
    y = materialize(supplier_years(spark, sf))
    rows = [(n, *linear.principal_components(y, list(cols), KEYS4)[1]) for n, cols in PAIRS.items()]
    return rounded(spark.createDataFrame(rows, "features string, pc1_share double, pc2_share double"), 7)


@query("E27_dispersion_per_label", f"""WITH {YEARS_SQL}, c AS (SELECT model, avg(discount) AS cx, avg(tax) AS cy FROM f1 GROUP BY 1), d AS (SELECT f1.*, sqrt((discount - cx) ** 2 + (tax - cy) ** 2) AS d FROM f1 JOIN c USING (model))
 SELECT model, count(*) AS n_samples, round(var_pop(discount), 9) AS variance_1, round(var_pop(tax), 9) AS variance_2, round(var_pop(discount) + var_pop(tax), 9) AS total_variance,
  round(avg(d), 8) AS mean_distance, round(stddev_pop(d), 8) AS std_distance, round(max(d), 8) AS max_distance FROM d GROUP BY 1""")
def e27(spark, sf):
    d = report.dispersion(supplier_years(spark, sf), "model", "discount", "tax")
    return rounded(rounded(d, 9, "variance_1", "variance_2", "total_variance"), 8, "mean_distance", "std_distance", "max_distance")


@query("J5_pca_dispersion")
def j5d(spark, sf):
    pc, _ = linear.principal_components(supplier_years(spark, sf), FEATURES, [*KEYS4, "year"])
    return rounded(report.dispersion(pc, "model", "pc1", "pc2"), 6)


@query("J6_assembled_matrix", UNI + f"""SELECT count(*) AS n_rows, CAST({len(UNI_COLS)} AS INTEGER) AS n_features, round(sum(v) / 1e6, 4) AS total_millions FROM
 (SELECT {K4}, sum(coalesce(value, 0)) AS v FROM ul GROUP BY ALL)""")
def j6(spark, sf):
    from pyspark.ml.functions import vector_to_array

    m = linear.assemble(unified(spark, sf), UNI_COLS, KEYS4)
    v = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return rounded(m.agg(F.count(F.lit(1)).alias("n_rows"), F.first(F.size(vector_to_array("features"))).alias("n_features"), (F.sum(v) / 1e6).alias("total_millions")), 4)


FAMS = {"size": ["quantity", "price"], "rate": ["discount", "tax"]}


@query("I14_family_correlation", f"""WITH {YEARS_SQL} SELECT 'size' AS family_1, 'rate' AS family_2, round((abs(corr(quantity, discount)) + abs(corr(quantity, tax)) + abs(corr(price, discount)) + abs(corr(price, tax))) / 4, 7) AS avg_abs_r,
 CAST(4 AS BIGINT) AS n FROM f1""")
def i14(spark, sf):
    return rounded(linear.family_correlation(supplier_years(spark, sf), FAMS), 7)


# ------------------------------------------------------------------------ splits


def keyed(spark, sf):
    """Supplier-year rows with one id and a 0/1 target."""
    y = supplier_years(spark, sf)
    return y.withColumns({
        "id": F.concat_ws("_", "domain", "field", "author_id", "model", "year"), "target": (F.col("field") == "F").cast("int")})


KEYED = YEARS_SQL + """, ky AS (SELECT *, domain || '_' || field || '_' || author_id || '_' || model || '_' || year AS id, CAST(field = 'F' AS INTEGER) AS target FROM f1),
 kh AS (SELECT *, md5(id || '#42') AS h, md5(id || '#43') AS h3 FROM ky)"""
UNIT = "CAST(('0x' || h[1:8]) AS BIGINT) / 4294967296.0::DOUBLE"


@query("L1_hash_split", f"WITH {KEYED} SELECT id, target, {UNIT} < 0.7 AS is_train FROM kh")
def l1(spark, sf):
    return split.split(keyed(spark, sf), "id", "target", 0.7).select("id", "target", "is_train")


@query("L1_exact_stratified_split", f"""WITH {KEYED}, r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY h || id) - 1 AS r, count(*) OVER (PARTITION BY target) AS n FROM kh)
 SELECT id, target, r < floor(n * 0.7::DOUBLE) AS is_train FROM r""")
def l1e(spark, sf):
    return split.split(keyed(spark, sf), "id", "target", 0.7, exact=True).select("id", "target", "is_train")


@query("L2_hash_folds", f"WITH {KEYED} SELECT id, CAST(floor({UNIT} * 5) AS INTEGER) AS fold FROM kh")
def l2(spark, sf):
    return split.folds(keyed(spark, sf), "id", "target").select("id", "fold")


@query("L2_exact_stratified_folds", f"WITH {KEYED} SELECT id, CAST((row_number() OVER (PARTITION BY target ORDER BY h || id) - 1) % 5 AS INTEGER) AS fold FROM kh")
def l2e(spark, sf):
    return split.folds(keyed(spark, sf), "id", "target", exact=True).select("id", "fold")


@query("L3_sample_per_group", f"WITH {KEYED} SELECT domain, id FROM kh QUALIFY row_number() OVER (PARTITION BY domain ORDER BY h, id) <= 25")
def l3(spark, sf):
    return split.sample_per_group(keyed(spark, sf), ["domain"], "id", 25).select("domain", "id")


@query("L4_class_weights", "SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)::DOUBLE), 8) AS weight FROM labels GROUP BY 1")
def l4(spark, sf):
    return rounded(split.class_weights(table(spark, sf, "labels").select("quality"), "quality"), 8)


@query("E33_class_presence", "SELECT lang, count(DISTINCT quality) >= 2 AS usable FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def e33(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return split.has_two_classes(d, ["lang"], "quality")


@query("E16_contingency_counts", f"""WITH {YEARS_SQL} SELECT field, domain, count(*) FILTER (model = 'N') AS "N", count(*) FILTER (model = 'A') AS "A", count(*) FILTER (model = 'R') AS "R" FROM f1 GROUP BY ALL""")
def e16(spark, sf):
    return supplier_years(spark, sf).groupBy("field", "domain").pivot("model", ["N", "A", "R"]).count().fillna(0, subset=["N", "A", "R"])


# ----------------------------------------------------------------------- metrics


def scored_items(spark, sf):
    """Line items with a bounded, heavily tied score and a 0/1 label."""
    i = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_discount") * 100 + F.col("l_tax") * 100).cast("int")
    return i.select(
        F.col("l_returnflag").alias("model"), (F.col("l_linestatus") == "O").cast("int").alias("label"), (cents / 18.0).alias("score"),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold")).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


SCORED = """si AS (SELECT l_returnflag AS model, CAST(l_linestatus = 'O' AS INTEGER) AS label, CAST(round(l_discount * 100 + l_tax * 100) AS INTEGER) / 18.0::DOUBLE AS score, CAST(l_orderkey % 5 AS INTEGER) AS fold FROM lineitem),
 sp AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM si)"""
BIN = """count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn"""


@query("K10_binary_metrics", f"""WITH {SCORED}, c AS (SELECT model, {BIN} FROM sp GROUP BY 1) SELECT *, round((tp + tn) / (tp + tn + fp + fn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS "precision",
 round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM c""")
def k10(spark, sf):
    conf = evaluate.confusion(scored_items(spark, sf), ["model"])
    return rounded(evaluate.binary_report(conf, ["model"], F.col("label") == 1, F.col("prediction") == 1), 8)


@query("K10_class_report", f"""WITH {SCORED}, c AS (SELECT model, k AS class, count(*) FILTER (label = k AND prediction = k) AS tp, count(*) FILTER (label = k) AS support, count(*) FILTER (prediction = k) AS pp FROM sp, (VALUES (0), (1)) v(k) GROUP BY ALL),
 m AS (SELECT model, class, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, coalesce(2 * tp / nullif(support + pp, 0), 0) AS f, support, tp FROM c)
 SELECT model, CAST(class AS VARCHAR) AS class, round(p, 8) AS "precision", round(r, 8) AS recall, round(f, 8) AS f1, support FROM m
 UNION ALL SELECT model, 'macro avg', round(avg(p), 8), round(avg(r), 8), round(avg(f), 8), CAST(sum(support) AS BIGINT) FROM m GROUP BY 1
 UNION ALL SELECT model, 'weighted avg', round(sum(p * support) / sum(support), 8), round(sum(r * support) / sum(support), 8), round(sum(f * support) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM m GROUP BY 1
 UNION ALL SELECT model, 'accuracy', round(sum(tp) / sum(support), 8), round(sum(tp) / sum(support), 8), round(sum(tp) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM m GROUP BY 1""")
def k10c(spark, sf):
    return rounded(evaluate.class_report(evaluate.confusion(scored_items(spark, sf), ["model"]), ["model"]), 8)


@query("K13_confusion_over_folds", f"WITH {SCORED} SELECT label, prediction, count(*) AS n FROM sp GROUP BY ALL")
def k13(spark, sf):
    return evaluate.confusion(scored_items(spark, sf), ["fold"]).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


@query("E22_fold_summary", f"""WITH {SCORED}, f AS (SELECT model, fold, avg(CAST(label = prediction AS INTEGER)) AS a FROM sp GROUP BY ALL)
 SELECT model, round(avg(a), 8) AS mean, round(stddev_pop(a), 8) AS std, round(min(a), 8) AS min, round(max(a), 8) AS max, round(max(a) - min(a), 8) AS range FROM f GROUP BY 1""")
def e22(spark, sf):
    acc = scored_items(spark, sf).groupBy("model", "fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("a"))
    return rounded(report.spread(acc, ["model"], "a"), 8)


@query("K16_threshold_sweep", f"""WITH {SCORED}, t AS (SELECT unnest([0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]::DOUBLE[]) AS threshold),
 c AS (SELECT model, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score < threshold) AS tn, count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn FROM sp, t GROUP BY ALL),
 a AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS acc FROM c)
 SELECT model, threshold, tp, tn, fp, fn, round(acc, 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall,
  row_number() OVER (PARTITION BY model ORDER BY acc DESC, threshold) = 1 AS best FROM a""")
def k16(spark, sf):
    return rounded(evaluate.threshold_sweep(scored_items(spark, sf), ["model"], "score", F.col("label") == 1), 8)


@query("K17_probability_distribution", f"""WITH {SCORED} SELECT model, label, count(*) AS n, round(avg(score), 7) AS mean, round(stddev_pop(score), 7) AS std, round(min(score), 7) AS min, round(max(score), 7) AS max,
 count(*) FILTER (abs(score - 0.5) < 0.1) AS near, round(median(score), 7) AS median, round(count(*) FILTER (abs(score - 0.5) < 0.1) / count(*), 7) AS near_share FROM sp GROUP BY ALL""")
def k17(spark, sf):
    return rounded(evaluate.probability_distribution(scored_items(spark, sf), ["model"], "score", "label"), 7)


@query("K7_nearest_neighbour_vote", f"""WITH {KEYED}, sl AS (SELECT *, {UNIT} < 0.7 AS is_train FROM kh), m AS (SELECT avg(quantity) AS a, stddev_pop(quantity) AS b, avg(discount) AS c, stddev_pop(discount) AS d, avg(tax) AS e, stddev_pop(tax) AS f FROM f1),
 x AS (SELECT id, target, is_train, [(quantity - a) / b, (discount - c) / d, (tax - e) / f] AS vec FROM sl, m),
 n AS (SELECT q.id, t.target FROM x q JOIN x t ON NOT q.is_train AND t.is_train QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, t.vec), t.id) <= 5)
 SELECT id, CAST(sum(target) >= 3 AS INTEGER) AS prediction, greatest(count(*) FILTER (target = 1), count(*) FILTER (target = 0)) AS votes FROM n GROUP BY 1""")
def k7(spark, sf):
    cols = ["quantity", "discount", "tax"]
    x = geometry.feature_vectors(linear.zscore(split.split(keyed(spark, sf), "id", "target", 0.7), cols), cols)
    x = x.select("id", "target", "is_train", "vec")
    near = knn.nearest(x.where("is_train"), x.where("NOT is_train"), "id", "vec", "target", 5)
    return knn.vote(near, "id")


# ------------------------------------------------------------------------ models


def author_table(spark, sf):
    """Unified author rows with id and target; the target is human = 1."""
    return unified(spark, sf).withColumns({
        "id": F.concat_ws("_", *KEYS4), "target": is_human().cast("int"), "year_label": F.col("model")})


def doc_table(spark, sf):
    """Labelled documents with their style features; the target is quality."""
    from wayline.functions.text import style_features

    d = document_texts(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return style_features(d).drop("text")


DOC_FEATURES = ["num_words", "word_diversity", "average_word_length", "avg_sentence_length", "function_word_ratio", "flesch_reading_ease", "gunning_fog"]


def doc_rows(spark, sf):
    return doc_table(spark, sf).select("doc_id", "domain", "year", "quality", *[F.col(c).cast("double").alias(c) for c in DOC_FEATURES])


@query("K1_impute_scale_logistic")
def k1(spark, sf):
    """Fitted on the training rows, reported on the held-out ones."""
    d = split.split(doc_rows(spark, sf).withColumn("label", F.col("quality").cast("double")), "doc_id", "label", 0.7, exact=True)
    d = materialize(split.with_class_weights(d.withColumn("gunning_fog", F.when(F.col("doc_id") % 7 != 0, F.col("gunning_fog"))), "label"))
    train = d.where("is_train")
    pred = models.impute_scale_logistic(DOC_FEATURES, train.count()).fit(train).transform(d.where("NOT is_train"))
    return rounded(evaluate.class_report(evaluate.confusion(pred.withColumn("g", F.lit(1)), ["g"]), ["g"]).drop("g"), 4)


LEVEL_OF = {"A": "LV1", "R": "LV2"}


def level_rows(spark, sf):
    """Supplier years as the levels' data sets: the reference side belongs to every level, each other side to its own; domain and all."""
    y = keyed(spark, sf).withColumn("target", (F.col("model") != "N").cast("int"))
    levels = F.when(F.col("model") == "N", F.array(*map(F.lit, LEVEL_OF.values()))).when(F.col("model") == "A", F.array(F.lit("LV1"))).otherwise(F.array(F.lit("LV2")))
    return y.withColumn("level", F.explode(levels)).withColumn("domain", F.explode(F.array("domain", F.lit("all"))))


def year_rows(spark, sf):
    """Supplier years by domain and by all domains, each year a slice; missing values are 0."""
    return keyed(spark, sf).fillna(0.0, subset=FEATURES).withColumn("domain", F.explode(F.array("domain", F.lit("all")))).withColumn("year", F.col("year").cast("string"))


SLICED = KEYED + """, lr AS (SELECT lv AS level, dm AS domain, id, CAST(model <> 'N' AS INTEGER) AS target, quantity, price, discount, tax, h, h3 FROM kh, (VALUES ('LV1', 'A'), ('LV2', 'R')) l(lv, md), (VALUES ('all'), (NULL)) d(dd), LATERAL (SELECT coalesce(dd, domain) AS dm) WHERE model IN ('N', md)),
 yr AS (SELECT CAST(year AS VARCHAR) AS year, dm AS domain, id, target, quantity, price, discount, tax, h, h3 FROM kh, (VALUES ('all'), (NULL)) d(dd), LATERAL (SELECT coalesce(dd, domain) AS dm))"""


def fold_sql(source, names):
    """Split 70/30 by class in every slice, folds of the training rows: sp(names, id, target, features, fold), fold -1 held out; ft: rows of each fit."""
    n = ", ".join(names)
    return f""", ok AS (SELECT {n} FROM {source} GROUP BY ALL HAVING count(DISTINCT target) = 2),
 s1 AS (SELECT s.*, row_number() OVER (PARTITION BY {n}, target ORDER BY h || id) - 1 < floor(count(*) OVER (PARTITION BY {n}, target) * 0.7::DOUBLE) AS is_train FROM {source} s JOIN ok USING ({n})),
 sp AS MATERIALIZED (SELECT * EXCLUDE (h, h3), CASE WHEN is_train THEN (row_number() OVER (PARTITION BY {n}, target, is_train ORDER BY h3 || id) - 1) % 5 ELSE -1 END AS fold FROM s1),
 ft AS (SELECT sp.*, f AS fit FROM sp, range(6) r(f) WHERE is_train AND fold <> f - 1)"""


def conditions_sql(source, names):
    """Sizes of every fit; at the minimum the gradient is zero."""
    n = ", ".join(names)
    return f"WITH {SLICED}{fold_sql(source, names)} SELECT {n}, CAST(fit AS INTEGER) AS fit, count(*) AS n_train, 0.0::DOUBLE AS gradient FROM ft GROUP BY ALL"


def conditions(df, names):
    rows, slices = batched.prepared(df, names, FEATURES, "target", "id")
    return rounded(batched.first_order(batched.regress(rows, slices, names, FEATURES, 5), rows, 1.0, True), 8)


def one_feature_sql(source, names, feature, rounds=10, known="true"):
    """The whole validation with one feature: Newton's method on two coefficients, written out round by round.

    Where ``known`` does not hold the feature is missing, and becomes the median of each fit's training rows.
    """
    n = ", ".join(names)
    on = f"USING ({n}, fit)"
    value = f"coalesce({feature}, md)"
    out = f"""WITH {SLICED}, hr AS (SELECT * REPLACE (CASE WHEN {known} THEN {feature} END AS {feature}) FROM {source}){fold_sql("hr", names)},
 vt AS (SELECT ft.*, median({feature}) OVER (PARTITION BY {n}, fit) AS md FROM ft),
 mo AS MATERIALIZED (SELECT {n}, fit, max(md) AS md, avg({value}) AS m, stddev_pop({value}) AS s, count(*) / 2.0::DOUBLE / count(*) FILTER (target = 0) AS w0, count(*) / 2.0::DOUBLE / count(*) FILTER (target = 1) AS w1 FROM vt GROUP BY {n}, fit),
 zf AS MATERIALIZED (SELECT {n}, fit, target AS y, (coalesce({feature}, mo.md) - m) / s AS z, CASE WHEN target = 1 THEN w1 ELSE w0 END AS w FROM ft JOIN mo {on}),
 b0 AS (SELECT {n}, fit, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM mo)"""
    for i in range(rounds):
        out += f""", g{i} AS (SELECT {n}, fit, b, c, sum(w * (y - p) * z) - b AS gb, sum(w * (y - p)) AS gc, sum(w * p * (1 - p) * z * z) + 1 AS hb, sum(w * p * (1 - p) * z) AS hm, sum(w * p * (1 - p)) AS hc
  FROM (SELECT zf.*, b, c, 1 / (1 + exp(-(b * z + c))) AS p FROM zf JOIN b{i} {on}) GROUP BY {n}, fit, b, c),
 b{i + 1} AS MATERIALIZED (SELECT {n}, fit, b + (hc * gb - hm * gc) / (hb * hc - hm * hm) AS b, c + (hb * gc - hm * gb) / (hb * hc - hm * hm) AS c FROM g{i})"""
    return out + f""", sc AS (SELECT {n}, fold, target AS y, 1 / (1 + exp(-(b * ({value} - m) / s + c))) AS score FROM sp JOIN mo USING ({n}) JOIN b{rounds} bb {on} WHERE fit = fold + 1),
 sz AS (SELECT {n}, count(*) FILTER (fold >= 0) AS n_train, count(*) FILTER (fold < 0) AS n_test, count(*) FILTER (y = 1) AS n_positive FROM sc GROUP BY ALL),
 te AS (SELECT *, score > 0.5 AS yes, rank() OVER (PARTITION BY {n} ORDER BY score) + (count(*) OVER (PARTITION BY {n}, score) - 1) / 2.0 AS rk FROM sc WHERE fold < 0),
 cf AS (SELECT {n}, count(*) FILTER (y = 1 AND yes) AS tp, count(*) FILTER (y = 0 AND yes) AS fp, count(*) FILTER (y = 1 AND NOT yes) AS fn, count(*) FILTER (y = 0 AND NOT yes) AS tn, CAST(sum(rk) FILTER (y = 1) AS DOUBLE) AS r FROM te GROUP BY ALL),
 cv AS (SELECT {n}, avg(a) AS cv_mean, stddev_pop(a) AS cv_std FROM (SELECT {n}, fold, avg(CAST((score > 0.5) = (y = 1) AS INTEGER)) AS a FROM sc WHERE fold >= 0 GROUP BY ALL) GROUP BY ALL)
 SELECT {n}, n_train, n_test, n_positive, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 5) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 5) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 5) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 5) AS f1, round((r - (tp + fn) * (tp + fn + 1) / 2.0) / ((tp + fn) * (fp + tn)), 5) AS auc, round(cv_mean, 5) AS cv_mean, round(cv_std, 5) AS cv_std
 FROM sz JOIN cf USING ({n}) JOIN cv USING ({n})"""


@query("K2_static_validation")
def k2(spark, sf):
    return rounded(batched.validation(level_rows(spark, sf), ["level", "domain"], FEATURES, "target", "id"), 5)


@query("K2_one_feature_validation", one_feature_sql("lr", ["level", "domain"], "price"))
def k2one(spark, sf):
    return rounded(batched.validation(level_rows(spark, sf), ["level", "domain"], ["price"], "target", "id"), 5)


@query("K1_median_imputed_validation", one_feature_sql("lr", ["level", "domain"], "price", known="quantity >= 24"))
def k1one(spark, sf):
    holed = level_rows(spark, sf).withColumn("price", F.when(F.col("quantity") >= 24, F.col("price")))
    return rounded(batched.validation(holed, ["level", "domain"], ["price"], "target", "id"), 5)


@query("K2_first_order_conditions", conditions_sql("lr", ["level", "domain"]))
def k2c(spark, sf):
    return conditions(level_rows(spark, sf), ["level", "domain"])


@query("K2_document_validation")
def k2d(spark, sf):
    return rounded(models.static_validation(doc_rows(spark, sf), DOC_FEATURES, "quality", "doc_id"), 4)


@query("K3_validation_per_year")
def k3(spark, sf):
    return rounded(batched.validation(year_rows(spark, sf), ["domain", "year"], FEATURES, "target", "id"), 5)


@query("K3_one_feature_validation", one_feature_sql("yr", ["domain", "year"], "quantity"))
def k3one(spark, sf):
    return rounded(batched.validation(year_rows(spark, sf), ["domain", "year"], ["quantity"], "target", "id"), 5)


@query("K3_first_order_conditions", conditions_sql("yr", ["domain", "year"]))
def k3c(spark, sf):
    return conditions(year_rows(spark, sf), ["domain", "year"])


@query("K4_year_split_binary")
def k4(spark, sf):
    train, test = models.year_split(doc_rows(spark, sf), "year", [2000, 2001, 2002, 2003], [2004])
    return rounded(models.binary_experiment(train, test, DOC_FEATURES, "quality"), 4)


@query("K5_year_split_multiclass")
def k5(spark, sf):
    train, test = models.year_split(doc_rows(spark, sf), "year", [2000, 2001, 2002, 2003], [2004])
    return rounded(models.multiclass_experiment(train, test, DOC_FEATURES, "domain"), 4)


@query("K6_classifier_panel")
def k6(spark, sf):
    d = split.split(doc_rows(spark, sf).withColumn("label", F.col("quality").cast("double")), "doc_id", "label", 0.8, exact=True)
    return rounded(models.evaluate_panel(d.where("is_train"), d.where("NOT is_train"), DOC_FEATURES, "doc_id"), 4)


def forest_results(spark, sf):
    """Predictions and importances of the forests on every feature set, kept under a key of the author table."""
    t = materialize(author_table(spark, sf))

    def make():
        predictions, weights = models.forest_sets(t, feat.feature_sets(t), "target", "id")
        return {"predictions": predictions, "importances": weights}

    return store.stored(spark, "forests", store.fingerprint(t), make)


@query("K8_forest_feature_sets")
def k8(spark, sf):
    return rounded(models.feature_set_report(forest_results(spark, sf)["predictions"]), 4)


@query("K18_space_separation")
def k18(spark, sf):
    t = author_table(spark, sf)
    sets = {k: v for k, v in feat.feature_sets(t).items() if k != "geometry_all"}
    return rounded(models.evaluate_feature_sets(t, sets, "target", "id", trees=100), 4)


@query("K9_out_of_fold_importance")
def k9(spark, sf):
    rows = forest_results(spark, sf)["importances"].where("feature_set = 'unified'")
    return rounded(rows.groupBy("feature").agg(F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("std")), 6)


@query("K9_fold_sizes", f"""WITH {KEYED}, a AS (SELECT DISTINCT domain, field, author_id, model FROM f1), i AS (SELECT domain || '_' || field || '_' || author_id || '_' || model AS id, CAST(model = 'N' AS DOUBLE) AS label FROM a),
 f AS (SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(id || '#42') || id) - 1) % 5 AS INTEGER) AS fold FROM i), s AS (SELECT unnest(['variability', 'geometry_ce', 'geometry_tfidf', 'geometry_sbert', 'geometry_all', 'unified']) AS feature_set)
 SELECT feature_set, fold, label, count(*) AS n FROM f, s GROUP BY ALL""")
def k9n(spark, sf):
    """Every row is predicted once for every feature set, by the forest that left out its fold."""
    return forest_results(spark, sf)["predictions"].groupBy("feature_set", "fold", "label").agg(F.count(F.lit(1)).alias("n"))


@query("K15_permutation_importance")
def k15(spark, sf):
    d = split.split(doc_rows(spark, sf).withColumn("label", F.col("quality").cast("double")), "doc_id", "label", 0.8, exact=True)
    d = materialize(d)
    cols = DOC_FEATURES
    model = models.impute_scale_logistic(cols, d.count(), weighted=False).fit(d.where("is_train"))
    return rounded(models.permutation_importance(model, d.where("NOT is_train"), cols, "doc_id", repeats=10), 6)


@query("K15_permuted_columns", f"""WITH {YEARS_SQL} SELECT CAST(r AS INTEGER) AS repeat, count(*) AS n, count(*) AS partners, round(sum(price), 2) AS price, round(sum(price * price) / 1e6, 3) AS squares, round(sum(tax), 6) AS tax FROM f1, range(10) t(r) GROUP BY 1""")
def k15p(spark, sf):
    """Every repeat meets every row once: sums over the partners are those over the rows."""
    d = keyed(spark, sf).select("id", "price", "tax")
    p = models.permuted(d, "id", ["price", "tax", "id"], 10, 42).select("repeat", "_other.*")
    return rounded(rounded(rounded(p.groupBy("repeat").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("partners"), F.sum("price").alias("price"), (F.sum(F.col("price") * F.col("price")) / 1e6).alias("squares"), F.sum("tax").alias("tax")), 2, "price"), 3, "squares"), 6, "tax")


@query("I15_logistic_wald_table")
def i15(spark, sf):
    return rounded(models.wald_table(materialize(doc_rows(spark, sf)), DOC_FEATURES, "quality"), 5)


def wald_fits(spark, sf, names=("level",)):
    """Regressions without a penalty on all rows of a level, and on all but one fold."""
    rows = level_rows(spark, sf).where("domain = 'all'")
    parted, slices = batched.prepared(rows, list(names), FEATURES, "target", "id", train_share=None)
    return batched.regress(parted, slices, list(names), FEATURES, 5, ridge=0.0, balanced=False), parted


@query("I15_wald_table_per_level")
def i15l(spark, sf):
    t = wald_fits(spark, sf)[0].coefficients(spark).where("fit = 0")
    return rounded(t.select("level", "n_train", "feature", "coef", "std_err", "z", "p_value", "odds_ratio", "settled"), 6)


@query("I16_fold_wald_table")
def i16(spark, sf):
    return rounded(batched.fold_summary(wald_fits(spark, sf)[0].coefficients(spark), ["level"]), 6)


WALD = f"WITH {SLICED}, wr AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY level, target ORDER BY h3 || id) - 1) % 5 AS fold FROM lr WHERE domain = 'all'), wf AS MATERIALIZED (SELECT wr.*, f AS fit FROM wr, range(6) r(f) WHERE fold <> f - 1)"


@query("I16_first_order_conditions", f"{WALD} SELECT level, CAST(fit AS INTEGER) AS fit, count(*) AS n_train, 0.0::DOUBLE AS gradient FROM wf GROUP BY ALL")
def i16c(spark, sf):
    fitted, rows = wald_fits(spark, sf)
    return rounded(batched.first_order(fitted, rows, 0.0, False), 8)


def _wald_sql(feature, rounds=8):
    """Fold-wise Wald tables of one feature: Newton's method on two coefficients; errors from the inverse of the second derivatives."""
    out = f"""{WALD}, mo AS MATERIALIZED (SELECT level, fit, avg({feature}) AS m, stddev_pop({feature}) AS s FROM wf GROUP BY ALL),
 zf AS MATERIALIZED (SELECT level, fit, target AS y, ({feature} - m) / s AS z FROM wf JOIN mo USING (level, fit)), b0 AS (SELECT level, fit, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM mo)"""
    for i in range(rounds + 1):
        out += f""", g{i} AS (SELECT level, fit, b, c, sum((y - p) * z) AS gb, sum(y - p) AS gc, sum(p * (1 - p) * z * z) AS hb, sum(p * (1 - p) * z) AS hm, sum(p * (1 - p)) AS hc FROM (SELECT zf.*, b, c, 1 / (1 + exp(-(b * z + c))) AS p FROM zf JOIN b{i} USING (level, fit)) GROUP BY level, fit, b, c),
 b{i + 1} AS MATERIALIZED (SELECT level, fit, b + (hc * gb - hm * gc) / (hb * hc - hm * hm) AS b, c + (hb * gc - hm * gb) / (hb * hc - hm * hm) AS c, sqrt(hc / (hb * hc - hm * hm)) AS eb, sqrt(hb / (hb * hc - hm * hm)) AS ec FROM g{i})"""
    p = f"CASE WHEN abs(z) > 5 THEN 0 ELSE {normal_p_sql('abs(z)')} END"  # beyond 5 it is under 1e-6
    return out + f""", co AS (SELECT level, fit, '{feature}' AS feature, b AS coef, eb AS std_err FROM b{rounds + 1} UNION ALL SELECT level, fit, 'intercept', c, ec FROM b{rounds + 1}), zt AS (SELECT *, coef / std_err AS z FROM co WHERE fit > 0),
 pt AS (SELECT *, {p} AS p FROM zt)
 SELECT level, feature, round(avg(coef), 5) + 0.0 AS coef_mean, round(stddev_samp(coef), 5) AS coef_std, round(avg(p), 5) AS p_mean, round(stddev_samp(p), 5) AS p_std, round(min(p), 5) AS p_min, round(max(p), 5) AS p_max,
  round(exp(min_by(coef, fit)), 5) AS first_odds_ratio FROM pt GROUP BY ALL"""


@query("I16_one_feature_fold_wald_table", _wald_sql("tax"))
def i16one(spark, sf):
    rows, slices = batched.prepared(level_rows(spark, sf).where("domain = 'all'"), ["level"], ["tax"], "target", "id", train_share=None)
    return rounded(batched.fold_summary(batched.regress(rows, slices, ["level"], ["tax"], 5, ridge=0.0, balanced=False).coefficients(spark), ["level"]), 5)


@query("I16_document_fold_wald_table")
def i16d(spark, sf):
    return rounded(models.wald_folds(doc_rows(spark, sf), DOC_FEATURES, "quality", "doc_id"), 5)


K19 = f"""f AS (SELECT {K4}, feature, value FROM ul WHERE feature LIKE '%\\_cv' ESCAPE '\\')"""


@query("K19_author_dataset_per_statistic", UNI.rstrip() + f""", {K19} SELECT {K4}, CAST(model = 'N' AS INTEGER) AS target, """ + ", ".join(
    f"round(max(CASE WHEN feature = '{f}_cv' THEN value END), 6) AS {f}" for f in FEATURES) + " FROM f GROUP BY ALL")
def k19(spark, sf):
    return rounded(author_dataset(spark, sf, "cv"), 6)


def author_dataset(spark, sf, stat):
    """One statistic's columns under their bare feature names, with target human = 1."""
    t = unified(spark, sf)
    cols = feat.columns_like(t, suffix=f"_{stat}")
    cols = [c for c in cols if c.removesuffix(f"_{stat}") in FEATURES]
    return t.select(*KEYS4, is_human().cast("int").alias("target"), *[F.col(c).alias(c.removesuffix(f"_{stat}")) for c in cols])


STATISTICS = ("cv", "rmssd_norm", "masd_norm")
EVERY = (*STATISTICS, "all")


def author_results(spark, sf, statistics, importance=False):
    """Tables of the author experiment on the given statistics, "all" standing for all side by side: ids complete in every statistic, one
    shared split, the panel on each. Predictions, and on request importances; each statistic is kept under a key of the author table, so a
    report only waits for what it reads."""
    t = materialize(author_table(spark, sf).dropna(how="any", subset=[f"{f}_{s}" for f in FEATURES for s in STATISTICS]))
    key = store.fingerprint(t)
    sets = {s: [f"{f}_{s}" for f in FEATURES] for s in STATISTICS}
    sets["all"] = [c for cols in sets.values() for c in cols]

    def make(missing):
        d = materialize(split.split(t.withColumn("label", F.col("target").cast("double")), "id", "label", 0.8, exact=True))
        return models.author_experiment(d, {s: sets[s] for s in missing}, "id", importance)

    parts = store.stored_parts(spark, ["author-experiment"] if importance else ["author-experiment", "author-scores"], {s: f"{s}-{key}" for s in statistics}, make)
    return {name: reduce(DataFrame.unionByName, [p[name] for p in parts.values()]) for name in ("scores", "importances")[: 1 + importance]}


@query("K20_author_experiment")
def k20(spark, sf):
    return rounded(models.panel_report(author_results(spark, sf, EVERY)["scores"], ["statistic", "model"]), 4)


def model_importances(spark, sf):
    """(statistic, model, feature, importance) of the fitted panel, features by their bare names."""
    return bare_importances(author_results(spark, sf, STATISTICS, importance=True))


def bare_importances(results):
    return results["importances"].withColumn("feature", F.regexp_replace("feature", "_(cv|rmssd_norm|masd_norm)$", ""))


@query("K14_panel_importances")
def k14p(spark, sf):
    return rounded(model_importances(spark, sf), 6)


@query("K14_importance_sums", f"""SELECT s AS statistic, m AS model, 4::BIGINT AS n_features, 1.0::DOUBLE AS total FROM (VALUES ('cv'), ('rmssd_norm'), ('masd_norm')) a(s), (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting'), ('Decision Tree')) b(m)""")
def k14s(spark, sf):
    """Importances of trees and coefficients are shares of one."""
    w = model_importances(spark, sf).where(F.col("model").isin("Logistic Regression", "Random Forest", "Gradient Boosting", "Decision Tree"))
    return rounded(w.groupBy("statistic", "model").agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total")), 6)


@query("F17_panel_competition_rank")
def f17p(spark, sf):
    return rounded(report.competition_rank(model_importances(spark, sf), ["statistic", "model"], "importance"), 6)


@query("G4_best_panel_model")
def g4p(spark, sf):
    """The most accurate model of each statistic, and overall; ties go by name."""
    acc = models.panel_report(author_results(spark, sf, EVERY)["scores"], ["statistic", "model"]).select("statistic", "model", "accuracy")
    best = acc.groupBy("statistic").agg(F.min_by("model", F.struct(-F.col("accuracy"), "model")).alias("model"), F.max("accuracy").alias("accuracy"))
    return rounded(best, 4)
