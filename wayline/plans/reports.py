"""Queries for selection, reshape and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import features as feat
from wayline.functions.columns import rounded, unpivot
from wayline.functions.pvalues import stars, trend_class
from wayline.operators import evaluate, models, report
from wayline.operators.ordered import top_n
from wayline.operators.trend import slope_of
from wayline.plans.comparison import UNI, comparisons, is_human, per_feature_tests, unified, unified_long, win_counts
from wayline.plans.learning import STATISTICS, author_results, bare_importances, model_importances
from wayline.plans.registry import query
from wayline.plans.trajectory import K4, KEYS4, YL, long_years, yearly_stats
from wayline.sources.bindings import (
    EVENTS_SQL, FEATURES, ITEMS_SQL, LONG_SQL, ORDERS_SQL, YEARS_SQL, event_series, order_series, supplier_items, supplier_years, table,
    with_supplier_domain,
)

# --------------------------------------------------------- selection and predicates


def matches(domain=None, model=None, level=None, is_model=True):
    """Case-insensitive metadata filter; model and level apply to model rows only."""
    cond = F.lit(True)
    for col, want in (("domain", domain), *((("model", model), ("field", level)) if is_model else ())):
        if want:
            cond = cond & (F.lower(F.coalesce(F.col(col), F.lit(""))) == want.lower())
    return cond


@query("B16_metadata_filter", f"WITH {YEARS_SQL} SELECT {K4}, year, n FROM f1 WHERE lower(domain) = 'asia' AND lower(model) = 'a' AND lower(field) = 'o'")
def b16(spark, sf):
    return supplier_years(spark, sf).where(matches("Asia", "a", "o")).select(*KEYS4, "year", "n")


@query("B17_column_aliases", "SELECT c_mktsegment AS domain, count(DISTINCT c_custkey) AS authors, count(*) AS n FROM customer GROUP BY 1")
def b17(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("genre"), F.col("c_custkey").alias("batch"))
    df = feat.resolve_column(feat.resolve_column(df, "domain"), "author_id")
    return df.groupBy("domain").agg(F.count_distinct("author_id").alias("authors"), F.count(F.lit(1)).alias("n"))


@query("B18_numeric_features", "SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS feature, (SELECT count(*) FROM lineitem) AS n")
def b18(spark, sf):
    li = table(spark, sf, "lineitem")
    names = sorted(feat.numeric_features(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))
    return li.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n")


@query("B19_column_families", UNI + f"SELECT {K4}, round(max(CASE WHEN feature = 'ce_tortuosity' THEN value END), 5) AS ce_tortuosity, round(max(CASE WHEN feature = 'tfidf_tortuosity' THEN value END), 5) AS tfidf_tortuosity, "
       "round(max(CASE WHEN feature = 'sbert_tortuosity' THEN value END), 5) AS sbert_tortuosity FROM ul GROUP BY ALL")
def b19(spark, sf):
    u = unified(spark, sf)
    return rounded(u.select(*KEYS4, *feat.columns_like(u, suffix="_tortuosity")), 5)


@query("B20_named_feature_sets", UNI + f"""SELECT s AS feature_set, CAST(CASE s WHEN 'variability' THEN 12 WHEN 'unified' THEN 30 WHEN 'geometry_all' THEN 18 ELSE 6 END AS INTEGER) AS n_features, count(*) AS n_null_filled
 FROM (SELECT unnest(['variability', 'geometry_ce', 'geometry_tfidf', 'geometry_sbert', 'geometry_all', 'unified']) AS s) JOIN (SELECT {K4} FROM ul GROUP BY ALL) ON true GROUP BY ALL""")
def b20(spark, sf):
    u = unified(spark, sf)
    sets = feat.feature_sets(u)
    filled = u.fillna(0.0, subset=sets["unified"])
    whole = [F.struct(F.lit(k).alias("feature_set"), F.lit(len(v)).alias("n_features"), F.count_if(F.concat_ws(",", *v) != "").alias("n_null_filled")) for k, v in sets.items()]
    return filled.agg(F.array(*whole).alias("_r")).select(F.inline("_r"))


@query("B21_feature_groups", UNI + """SELECT feature_type, count(DISTINCT feature) AS n_features, count(*) AS n FROM cmp GROUP BY 1""")
def b21(spark, sf):
    return comparisons(spark, sf).groupBy("feature_type").agg(F.count_distinct("feature").alias("n_features"), F.count(F.lit(1)).alias("n"))


LAYER = {"Size": ["quantity", "price"], "Rate": ["discount", "tax"]}


@query("B22_feature_layers", UNI + """SELECT CASE WHEN regexp_replace(feature, '_(cv|rmssd_norm|masd_norm)$', '') IN ('quantity', 'price') THEN 'Size' WHEN regexp_replace(feature, '_(cv|rmssd_norm|masd_norm)$', '') IN ('discount', 'tax') THEN 'Rate' END AS layer,
 count(*) AS n FROM ul GROUP BY 1""")
def b22(spark, sf):
    return feat.with_layer(unified_long(spark, sf), feat.feature_dim(spark, LAYER)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("B23_feature_metric_split", UNI + "SELECT regexp_replace(feature, '_(cv|rmssd_norm|masd_norm)$', '') AS base, nullif(regexp_extract(feature, '_(cv|rmssd_norm|masd_norm)$', 1), '') AS metric, count(*) AS n FROM ul GROUP BY ALL")
def b23(spark, sf):
    f = F.col("feature")
    return unified_long(spark, sf).groupBy(feat.base_feature(f).alias("base"), feat.stat_suffix(f).alias("metric")).agg(F.count(F.lit(1)).alias("n"))


@query("B24_prefixed_metrics", YL + f"SELECT {K4}, feature, round(rmssd / nullif(abs(mean), 0), 6) AS ce_rmssd_norm, round(masd / nullif(abs(mean), 0), 6) AS ce_masd_norm FROM s")
def b24(spark, sf):
    st = yearly_stats(spark, sf).select(*KEYS4, "feature", "rmssd_norm", "masd_norm")
    return rounded(feat.with_prefix(st, "ce_", [*KEYS4, "feature"]), 6)


@query("B25_key_defaults", f"WITH {YEARS_SQL} SELECT CASE WHEN model = 'N' THEN 'human' ELSE model END AS model, 'LV3' AS level, count(*) AS n FROM f1 GROUP BY 1")
def b25(spark, sf):
    df = supplier_years(spark, sf).withColumn("model", F.when(~is_human(), F.col("model")))
    return feat.with_defaults(df, {"model": "human", "level": "LV3"}).groupBy("model", "level").agg(F.count(F.lit(1)).alias("n"))


@query("B26_no_duplicate_columns", f"WITH {YEARS_SQL} SELECT a.author_id, a.year, count(*) AS n, round(sum(b.tax), 8) AS tax FROM f1 a JOIN f1 b USING (domain, field, author_id, model, year) GROUP BY ALL")
def b26(spark, sf):
    """Both sides carry year and model; the right side keeps its payload only."""
    y = supplier_years(spark, sf)
    keys = [*KEYS4, "year"]
    both = y.select(*keys, "price").join(y.select(*keys, "tax"), keys)
    assert len(both.columns) == len(set(both.columns))
    return rounded(both.groupBy("author_id", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("tax").alias("tax")), 8)


@query("B27_lenient_numbers", "SELECT event_type, count(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE)) AS n_numbers, count(*) AS n FROM events GROUP BY 1")
def b27(spark, sf):
    df = table(spark, sf, "events").withColumn("raw", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string")))
    return feat.lenient_double(df, ["raw"]).groupBy("event_type").agg(F.count("raw").alias("n_numbers"), F.count(F.lit(1)).alias("n"))


@query("B28_complete_cases", f"""WITH {YEARS_SQL} SELECT model, count(*) FILTER (n > 8 AND author_id % 3 <> 0) AS complete, count(*) AS total FROM f1 GROUP BY 1""")
def b28(spark, sf):
    y = supplier_years(spark, sf).withColumns({
        "price": F.when(F.col("n") > 8, F.col("price")), "tax": F.when(F.pmod("author_id", F.lit(3)) != 0, F.col("tax"))})
    done = y.dropna(how="any", subset=["price", "tax"]).groupBy("model").agg(F.count(F.lit(1)).alias("complete"))
    return y.groupBy("model").agg(F.count(F.lit(1)).alias("total")).join(done, "model", "left").fillna(0).select("model", "complete", "total")


@query("B29_year_predicates", f"WITH {ORDERS_SQL} SELECT CASE WHEN year IN (1995, 1996, 1997) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM f2 WHERE year >= 1995 GROUP BY 1")
def b29(spark, sf):
    o = order_series(spark, sf).where("year >= 1995")
    part = F.when(F.col("year").isin(1995, 1996, 1997), "train").otherwise("test")
    return o.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("B30_targets", f"WITH {YEARS_SQL} SELECT CAST(model <> 'N' AS INTEGER) AS target, CASE WHEN model = 'N' THEN 'HUMAN' ELSE upper(model) END AS source, count(*) AS n FROM f1 GROUP BY ALL")
def b30(spark, sf):
    target = F.when(is_human(), 0).otherwise(1)
    source = F.when(is_human(), "HUMAN").otherwise(F.upper("model"))
    return supplier_years(spark, sf).groupBy(target.alias("target"), source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("B31_sample_id", f"WITH {YEARS_SQL} SELECT DISTINCT domain || '_' || field || '_' || author_id || '_' || model AS sample_id FROM f1")
def b31(spark, sf):
    return supplier_years(spark, sf).select(F.concat_ws("_", *KEYS4).alias("sample_id")).distinct()


@query("B32_stars_and_verdict", UNI + """, t AS (SELECT feature, count(*) AS n, CAST(sum(human_wins) AS BIGINT) AS k FROM cmp GROUP BY ALL),
 p AS (SELECT *, least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) AS p FROM t)
 SELECT feature, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS significant_star, CASE WHEN p < 0.05 THEN 'Human > LLM' ELSE 'not significant' END AS verdict FROM p""")
def b32(spark, sf):
    p = F.col("pvalue")
    return per_feature_tests(spark, sf).select("feature", stars(p).alias("significant_star"), F.when(p < 0.05, "Human > LLM").otherwise("not significant").alias("verdict"))


@query("B33_trend_classes", f"WITH {LONG_SQL}, s AS (SELECT {K4}, feature, regr_slope(value, year) AS s FROM f1l GROUP BY ALL) SELECT feature, CASE WHEN s < 0 THEN 'decreasing' WHEN s > 0 THEN 'increasing' WHEN s = 0 THEN 'stable' ELSE 'insufficient' END AS trend, count(*) AS n FROM s GROUP BY ALL")
def b33(spark, sf):
    s = long_years(spark, sf).groupBy(*KEYS4, "feature").agg(slope_of(F.col("value"), F.col("year").cast("double")).alias("s"))
    return s.groupBy("feature", trend_class(F.col("s"), "decreasing", "increasing").alias("trend")).agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- sets and reshape


@query("H1_union_with_schema_drift", "SELECT * FROM (SELECT 'orders' AS src, count(*) AS n, round(sum(o_totalprice) / 1e6, 4) AS total, NULL::BIGINT AS n_types FROM orders UNION ALL SELECT 'events', count(*), NULL, count(DISTINCT event_type) FROM events)")
def h1(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_totalprice").alias("price"))
    e = table(spark, sf, "events").select(F.lit("events").alias("src"), F.col("event_type"))
    u = o.unionByName(e, allowMissingColumns=True)
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price") / 1e6, 4).alias("total"), F.nullif(F.count_distinct("event_type"), F.lit(0)).alias("n_types"))


@query("H2_intersect_ids", f"WITH {ORDERS_SQL} SELECT author_id FROM f2 WHERE model = 'F' INTERSECT SELECT author_id FROM f2 WHERE model = 'P'")
def h2(spark, sf):
    o = order_series(spark, sf)
    return o.where("model = 'F'").select("author_id").intersect(o.where("model = 'P'").select("author_id"))


LEVELS = UNI + """, lv AS (SELECT 'LV' || (1 + author_id % 3) AS level, feature_type, avg(human_wins) AS rate FROM cmp GROUP BY ALL) """


def rates_by_level(spark, sf):
    """Win rates per level, from one pass over the authors."""
    c = win_counts(spark, sf, "level").groupBy("level", "feature_type").agg((F.sum("human_wins") / F.sum("n")).alias("rate"))
    return c.select("feature_type", "rate", "level")


@query("H3_level_tagged_union", LEVELS + "SELECT level, feature_type, round(rate, 8) AS rate FROM lv")
def h3(spark, sf):
    return rounded(rates_by_level(spark, sf), 8)


@query("H4_unpivot", f"WITH {LONG_SQL} SELECT {K4}, year, feature, round(value, 6) AS value FROM f1l")
def h4(spark, sf):
    return rounded(long_years(spark, sf), 6)


@query("H5_pivot_model_by_statistic", YL + """SELECT model, round(avg(sqrt(variance) / abs(mean)) FILTER (feature = 'quantity'), 8) AS quantity, round(avg(sqrt(variance) / abs(mean)) FILTER (feature = 'price'), 8) AS price,
 round(avg(sqrt(variance) / abs(mean)) FILTER (feature = 'discount'), 8) AS discount, round(avg(sqrt(variance) / abs(mean)) FILTER (feature = 'tax'), 8) AS tax FROM s GROUP BY 1""")
def h5(spark, sf):
    return rounded(yearly_stats(spark, sf).groupBy("model").pivot("feature", FEATURES).agg(F.avg("cv")), 8)


@query("H7_level_comparison", LEVELS + """, p AS (SELECT feature_type, max(CASE WHEN level = 'LV1' THEN rate END) AS a, max(CASE WHEN level = 'LV2' THEN rate END) AS b, max(CASE WHEN level = 'LV3' THEN rate END) AS c FROM lv GROUP BY 1)
 SELECT feature_type, round(a, 8) AS "LV1", round(b, 8) AS "LV2", round(c, 8) AS "LV3", round(greatest(a, b, c) - least(a, b, c), 8) AS range FROM p""")
def h7(spark, sf):
    return rounded(report.level_comparison(rates_by_level(spark, sf), "feature_type", "level", "rate", ["LV1", "LV2", "LV3"]), 8)


@query("E21_robustness_across_levels", LEVELS + "SELECT feature_type, round(avg(rate), 8) AS mean, round(stddev_pop(rate), 8) AS std, round(min(rate), 8) AS min, round(max(rate), 8) AS max, round(max(rate) - min(rate), 8) AS range FROM lv GROUP BY 1")
def e21(spark, sf):
    return rounded(report.spread(rates_by_level(spark, sf), ["feature_type"], "rate"), 8)


@query("H8_tidy_results", YL + """, r AS (SELECT 'cv' AS statistic, model, sqrt(variance) / abs(mean) AS v FROM s UNION ALL SELECT 'masd_norm', model, masd / abs(mean) FROM s UNION ALL SELECT 'rmssd_norm', model, rmssd / abs(mean) FROM s)
 SELECT statistic, round(avg(v), 8) AS mean, count(*) AS n FROM r GROUP BY 1""")
def h8(spark, sf):
    tidy = unpivot(yearly_stats(spark, sf), ["model"], ["cv", "rmssd_norm", "masd_norm"], feature="statistic", value="v")
    return rounded(tidy.groupBy("statistic").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")), 8)


# ----------------------------------------------------------- ranks and summaries

IMP = YL + """, im AS (SELECT 'cv' AS statistic, model, feature, round(avg(sqrt(variance) / abs(mean)), 3) AS importance FROM s GROUP BY ALL UNION ALL
  SELECT 'rmssd_norm', model, feature, round(avg(rmssd / abs(mean)), 3) FROM s GROUP BY ALL UNION ALL SELECT 'masd_norm', model, feature, round(avg(masd / abs(mean)), 3) FROM s GROUP BY ALL),
 rk AS (SELECT *, CAST(rank() OVER (PARTITION BY statistic, model ORDER BY importance DESC) AS INTEGER) AS rank FROM im)"""


def importances(spark, sf):
    """Mean statistic per (statistic, model, feature), standing in for model importances."""
    tidy = unpivot(yearly_stats(spark, sf), ["model", "feature"], ["cv", "rmssd_norm", "masd_norm"], feature="statistic", value="v")
    return tidy.groupBy("statistic", "model", "feature").agg(F.round(F.avg("v"), 3).alias("importance"))


def ranked(spark, sf):
    return report.competition_rank(importances(spark, sf), ["statistic", "model"], "importance")


@query("F17_competition_rank", IMP + " SELECT * FROM rk")
def f17(spark, sf):
    return ranked(spark, sf)


@query("F18_sequential_rank", IMP + " SELECT statistic, model, feature, CAST(row_number() OVER (PARTITION BY statistic, model ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM im")
def f18(spark, sf):
    return report.sequential_rank(importances(spark, sf), ["statistic", "model"], "importance", "feature").drop("importance")


@query("G3_top_per_group", IMP + " SELECT statistic, model, feature FROM im QUALIFY row_number() OVER (PARTITION BY statistic, model ORDER BY importance DESC, feature) <= 2")
def g3(spark, sf):
    return report.top_per_group(importances(spark, sf), ["statistic", "model"], "importance", "feature", 2).select("statistic", "model", "feature")


SUMM = IMP + ", sm AS (SELECT statistic, feature, avg(importance) AS ai, max(importance) AS mi, min(rank) AS mr, avg(rank) AS ar, count(*) AS k FROM rk GROUP BY ALL)"


@query("E23_importance_summary", SUMM + " SELECT statistic, feature, round(ai, 7) AS avg_importance, mi AS max_importance, mr AS min_rank, round(ar, 7) AS avg_rank, k AS appears_in_models FROM sm")
def e23(spark, sf):
    return rounded(report.importance_summary(ranked(spark, sf)), 7)


@query("E23_importance_consistency", SUMM + " SELECT feature, round(avg(ar), 7) AS avg_rank, round(avg(ai), 7) AS avg_importance, count(*) AS num_statistics FROM sm GROUP BY 1")
def e23c(spark, sf):
    return rounded(report.importance_consistency(report.importance_summary(ranked(spark, sf))), 7)


RES = IMP + ", re AS (SELECT statistic, model, round(sum(importance), 3) AS accuracy FROM im GROUP BY ALL), bm AS (SELECT statistic, max_by(model, (accuracy, model)) AS model, max(accuracy) AS accuracy FROM re GROUP BY 1)"


def results(spark, sf):
    return importances(spark, sf).groupBy("statistic", "model").agg(F.round(F.sum("importance"), 3).alias("accuracy"))


@query("G4_best_model", RES + " SELECT statistic, model, accuracy FROM bm")
def g4(spark, sf):
    return report.best_model(results(spark, sf), ["statistic"])


@query("E24_importance_of_best_models", RES + """, f AS (SELECT feature, avg(importance) AS importance FROM im JOIN (SELECT statistic, model FROM bm) USING (statistic, model) GROUP BY 1)
 SELECT CASE WHEN feature IN ('quantity', 'price') THEN 'Size' ELSE 'Rate' END AS layer, round(sum(importance), 7) AS total, round(avg(importance), 7) AS mean, count(*) AS n FROM f GROUP BY 1""")
def e24(spark, sf):
    best = report.best_model(results(spark, sf), ["statistic"]).select("statistic", "model")
    f = importances(spark, sf).join(best, ["statistic", "model"]).groupBy("feature").agg(F.avg("importance").alias("importance"))
    return rounded(feat.with_layer(f, feat.feature_dim(spark, LAYER)).groupBy("layer").agg(
        F.sum("importance").alias("total"), F.avg("importance").alias("mean"), F.count(F.lit(1)).alias("n")), 7)


@query("E25_importance_by_type", IMP + """ SELECT statistic, round(avg(importance), 7) AS mean, round(stddev_samp(importance), 7) AS std, max(importance) AS max, count(*) AS n,
 array_to_string(list(feature || '/' || model ORDER BY feature, model)[1:3], ', ') AS first_names FROM im GROUP BY 1""")
def e25(spark, sf):
    return rounded(importance_by_type(importances(spark, sf)), 7)


def importance_by_type(rows):
    """Mean, deviation, largest and number of importances per statistic, and its first three names."""
    name = F.concat_ws("/", "feature", "model")
    first = top_n(rows.withColumn("name", name), ["statistic"], [F.col("feature"), F.col("model")], 3, salt="name")
    first = first.groupBy("statistic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "name"))), lambda x: x["name"]), ", ").alias("first_names"))
    stats = rows.groupBy("statistic").agg(
        F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"), F.max("importance").alias("max"), F.count(F.lit(1)).alias("n"))
    return stats.join(first, "statistic")


# The same reports over the importances of the fitted panel, which the author experiment keeps.


def panel_ranked(spark, sf):
    return report.competition_rank(model_importances(spark, sf), ["statistic", "model"], "importance")


@query("F18_panel_sequential_rank")
def f18p(spark, sf):
    return report.sequential_rank(model_importances(spark, sf), ["statistic", "model"], "importance", "feature").drop("importance")


@query("G3_panel_top_per_group")
def g3p(spark, sf):
    return report.top_per_group(model_importances(spark, sf), ["statistic", "model"], "importance", "feature", 2).select("statistic", "model", "feature")


@query("E23_panel_importance_summary")
def e23p(spark, sf):
    return rounded(report.importance_summary(panel_ranked(spark, sf)), 6)


@query("E23_panel_importance_consistency")
def e23pc(spark, sf):
    return rounded(report.importance_consistency(report.importance_summary(panel_ranked(spark, sf))), 6)


@query("E24_panel_importance_of_best_models")
def e24p(spark, sf):
    made = author_results(spark, sf, STATISTICS, importance=True)
    acc = models.panel_report(made["scores"], ["statistic", "model"])
    best = report.best_model(acc, ["statistic"]).select("statistic", "model")
    f = bare_importances(made).join(best, ["statistic", "model"]).groupBy("feature").agg(F.avg("importance").alias("importance"))
    return rounded(feat.with_layer(f, feat.feature_dim(spark, LAYER)).groupBy("layer").agg(
        F.sum("importance").alias("total"), F.avg("importance").alias("mean"), F.count(F.lit(1)).alias("n")), 6)


@query("E25_panel_importance_by_type")
def e25p(spark, sf):
    return rounded(importance_by_type(model_importances(spark, sf)), 6)


@query("K14_normalised_importance", IMP + " SELECT statistic, model, feature, round(abs(importance) / sum(abs(importance)) OVER (PARTITION BY statistic, model), 8) AS importance FROM im")
def k14(spark, sf):
    return rounded(evaluate.normalised_importance(importances(spark, sf), ["statistic", "model"]), 8)


DIFFS = f"""WITH {ITEMS_SQL}, m AS (SELECT domain, model, avg(quantity) AS quantity, avg(price) / 1000 AS price, avg(discount) AS discount, avg(tax) AS tax FROM items GROUP BY ALL),
 l AS (SELECT a.domain, a.model, unnest(['quantity', 'price', 'discount', 'tax']) AS feature, unnest([a.quantity - b.quantity, a.price - b.price, a.discount - b.discount, a.tax - b.tax]) AS d FROM m a JOIN m b USING (domain) WHERE a.model <> 'N' AND b.model = 'N')"""


@query("G6_top_features_by_difference", DIFFS + " SELECT feature, round(avg(abs(d)), 7) AS mean_abs_difference FROM l GROUP BY 1 ORDER BY mean_abs_difference DESC, feature LIMIT 30")
def g6(spark, sf):
    from wayline.operators.compare import baseline_difference

    part = supplier_items(spark, sf).groupBy("author_id", "model").agg(F.count(F.lit(1)).alias("c"), *[F.sum(f).alias(f) for f in FEATURES])
    m = with_supplier_domain(spark, sf, part).groupBy("domain", "model").agg(
        *[(F.sum(f) / F.sum("c") / (1000 if f == "price" else 1)).alias(f) for f in FEATURES])
    long = unpivot(baseline_difference(m, "domain", is_human(), FEATURES), ["domain", "model"], FEATURES)
    top = long.groupBy("feature").agg(F.round(F.avg(F.abs("value")), 7).alias("mean_abs_difference"))
    return top.orderBy(F.desc("mean_abs_difference"), "feature").limit(30)


@query("E29_fixed_histogram", f"""WITH {EVENTS_SQL}, b AS (SELECT field, min(value) AS lo, max(value) AS hi FROM f3 GROUP BY 1)
 SELECT field, CAST(least(floor((value - lo) / ((hi - lo) / 30.0::DOUBLE)), 29) AS INTEGER) AS bin, count(*) AS n FROM f3 JOIN b USING (field) GROUP BY ALL""")
def e29(spark, sf):
    e = event_series(spark, sf)
    b = e.groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return report.fixed_bins(e.join(b, "field"), ["field"], "value", F.col("lo"), F.col("hi"), 30)


@query("E29_quantile_histogram", f"""WITH {EVENTS_SQL}, q AS (SELECT field, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM f3 GROUP BY 1)
 SELECT field, round(lo, 6) AS x_min, round(hi, 6) AS x_max, CAST(least(floor((value - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS bin, count(*) AS n
 FROM f3 JOIN q USING (field) WHERE value BETWEEN lo AND hi GROUP BY ALL""")
def e29q(spark, sf):
    return rounded(report.quantile_histogram(event_series(spark, sf), ["field"], "value", 50), 6, "x_min", "x_max")


@query("E31_mean_over_family", f"WITH {YEARS_SQL} SELECT {K4}, year, round(CASE WHEN author_id % 3 = 0 THEN tax ELSE (discount + tax) / 2 END, 8) AS rate_mean FROM f1")
def e31(spark, sf):
    y = supplier_years(spark, sf).withColumn("discount", F.when(F.pmod("author_id", F.lit(3)) != 0, F.col("discount")))
    return rounded(y.select(*KEYS4, "year", feat.mean_of(["discount", "tax"]).alias("rate_mean")), 8)


