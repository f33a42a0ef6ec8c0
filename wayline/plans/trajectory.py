"""Queries for series, masking and path geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions.columns import rounded, unpivot
from wayline.operators import clean, geometry, series
from wayline.plans.registry import query
from wayline.sources.bindings import (
    EVENTS_SQL, FEATURES, ITEMS_SQL, LONG_SQL, ORDERS_SQL, VECTORS_SQL, YEARS_SQL,
    event_series, order_series, supplier_items, supplier_years, vector_items, with_supplier_domain,
)

KEYS4 = ["domain", "field", "author_id", "model"]
K4 = ", ".join(KEYS4)


def long_years(spark, sf):
    return unpivot(supplier_years(spark, sf), [*KEYS4, "year"], FEATURES)


def masked_events(spark, sf):
    return clean.mask_outliers(event_series(spark, sf), ["field"], "value")


# --------------------------------------------------------------- aggregates E1-E3


@query("E1_author_year_vectors", f"""WITH {VECTORS_SQL}, e AS (
  SELECT author_id, year, item, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vecs)
 SELECT author_id, year, CAST(i AS INTEGER) AS dim, round(avg(x), 9) AS value, count(*) AS n_items FROM e GROUP BY ALL""")
def e1(spark, sf):
    v = geometry.yearly_vectors(vector_items(spark, sf), ["author_id", "year"])
    return v.select("author_id", "year", "n_items", F.posexplode("vec").alias("dim", "value")).select(
        "author_id", "year", (F.col("dim") + 1).alias("dim"), F.round("value", 9).alias("value"), "n_items")


@query("E2_author_year_means", f"""WITH {YEARS_SQL} SELECT {K4}, year, round(quantity, 6) AS quantity, round(price, 6) AS price,
 round(discount, 8) AS discount, round(tax, 8) AS tax, n FROM f1""")
def e2(spark, sf):
    return rounded(rounded(supplier_years(spark, sf), 6, "quantity", "price"), 8, "discount", "tax")


@query("E3_domain_year_means", f"""WITH {ITEMS_SQL} SELECT domain, model, year, round(avg(quantity), 9) AS quantity,
 round(avg(price), 7) AS price, round(avg(discount), 11) AS discount, round(avg(tax), 11) AS tax FROM items GROUP BY ALL""")
def e3(spark, sf):
    df = domain_years(spark, sf)
    return rounded(rounded(rounded(df, 9, "quantity"), 7, "price"), 11, "discount", "tax")


def domain_years(spark, sf):
    """Domain-year means; sums per supplier first, so the join sees one row per supplier and year."""
    part = supplier_items(spark, sf).groupBy("author_id", "model", "year").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in FEATURES])
    return with_supplier_domain(spark, sf, part).groupBy("domain", "model", "year").agg(
        *[(F.sum(f) / F.sum("n")).alias(f) for f in FEATURES])


# ------------------------------------------------------------------- variability

SERIES_SQL = """d AS (SELECT *, value - lag(value) OVER (PARTITION BY {keys} ORDER BY {order}) AS d FROM {src} WHERE value IS NOT NULL),
 s AS (SELECT {keys}, count(*) AS n_values, avg(value) AS mean, var_samp(value) AS variance, sqrt(avg(d * d)) AS rmssd, avg(abs(d)) AS masd
       FROM d GROUP BY ALL)"""


def series_sql(keys, order, src):
    return SERIES_SQL.format(keys=keys, order=order, src=src)


EV = "author_id, field"


@query("F1_successive_differences", f"""WITH {EVENTS_SQL} SELECT author_id, field, item,
 round(value - lag(value) OVER (PARTITION BY {EV} ORDER BY ts, item), 6) AS diff FROM f3""")
def f1(spark, sf):
    df = series.successive_differences(event_series(spark, sf), ["author_id", "field"], ["ts", "item"], block="day")
    return df.select("author_id", "field", "item", F.round("diff", 6).alias("diff"))


MASK_SQL = """qb AS (SELECT field, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f3 GROUP BY field),
 mk AS (SELECT f3.author_id, f3.field, f3.ts, f3.item, f3.day, CASE WHEN q3 - q1 = 0 OR value BETWEEN q1 - 1.500000001::DOUBLE * (q3 - q1) AND q3 + 1.500000001::DOUBLE * (q3 - q1)
   THEN value END AS value FROM f3 JOIN qb USING (field))"""


@query("F1_differences_bridge_gaps", f"""WITH {EVENTS_SQL}, {MASK_SQL} SELECT author_id, field, item,
 round(value - lag(value) OVER (PARTITION BY {EV} ORDER BY ts, item), 6) AS diff FROM mk WHERE value IS NOT NULL""")
def f1m(spark, sf):
    df = series.successive_differences(masked_events(spark, sf), ["author_id", "field"], ["ts", "item"], block="day")
    return df.where("value IS NOT NULL").select("author_id", "field", "item", F.round("diff", 6).alias("diff"))


def _event_stats(spark, sf, *cols):
    df = series.variability(event_series(spark, sf), ["author_id", "field"], ["ts", "item"], block="day")
    return df.select("author_id", "field", *cols)


EVS = f"WITH {EVENTS_SQL}, {series_sql(EV, 'ts, item', 'f3')} "


@query("F2_rmssd_events", EVS + "SELECT author_id, field, n_values, round(rmssd, 6) AS rmssd FROM s")
def f2(spark, sf):
    return rounded(_event_stats(spark, sf, "n_values", "rmssd"), 6)


@query("F3_masd_events", EVS + "SELECT author_id, field, round(masd, 6) AS masd FROM s")
def f3(spark, sf):
    return rounded(_event_stats(spark, sf, "masd"), 6)


@query("F4_normalised_differences", EVS + """SELECT author_id, field, round(rmssd / nullif(abs(mean), 0), 6) AS rmssd_norm,
 round(masd / nullif(abs(mean), 0), 6) AS masd_norm FROM s""")
def f4(spark, sf):
    return rounded(_event_stats(spark, sf, "rmssd_norm", "masd_norm"), 6)


@query("E6_dispersion_events", EVS + """SELECT author_id, field, round(mean, 6) AS mean, round(sqrt(variance), 6) AS sample_sd,
 round(sqrt(variance) / nullif(abs(mean), 0), 6) AS cv FROM s""")
def e6(spark, sf):
    return rounded(_event_stats(spark, sf, "mean", F.sqrt("variance").alias("sample_sd"), "cv"), 6)


@query("E6_dispersion_orders", f"""WITH {ORDERS_SQL}, {series_sql('domain, author_id', 'year, item', 'f2')}
 SELECT domain, author_id, n_values, round(mean, 6) AS mean, round(sqrt(variance) / nullif(abs(mean), 0), 6) AS cv,
  round(rmssd / nullif(abs(mean), 0), 6) AS rmssd_norm FROM s""")
def e6o(spark, sf):
    df = series.variability(order_series(spark, sf), ["domain", "author_id"], ["year", "item"], block="year")
    return rounded(df.select("domain", "author_id", "n_values", "mean", "cv", "rmssd_norm"), 6)


@query("E7_sample_counts", f"""WITH {EVENTS_SQL}, {MASK_SQL} SELECT author_id, field, count(*) AS sample_count, count(value) AS n_values FROM mk GROUP BY ALL""")
def e7(spark, sf):
    df = series.variability(masked_events(spark, sf), ["author_id", "field"], ["ts", "item"], block="day")
    return df.select("author_id", "field", "sample_count", "n_values")


YL = f"WITH {LONG_SQL}, {series_sql(K4 + ', feature', 'year', 'f1l')} "


@query("F5_author_table_long", YL + f"""SELECT {K4}, feature, round(variance / nullif(mean * mean, 0), 6) AS rel_variance,
 round(sqrt(variance) / nullif(abs(mean), 0), 6) AS cv, round(rmssd / nullif(abs(mean), 0), 6) AS rmssd_norm,
 round(masd / nullif(abs(mean), 0), 6) AS masd_norm FROM s""")
def f5(spark, sf):
    df = yearly_stats(spark, sf)
    rel = F.col("variance") / F.nullif(F.col("mean") * F.col("mean"), F.lit(0.0))
    return rounded(df.select(*KEYS4, "feature", rel.alias("rel_variance"), "cv", "rmssd_norm", "masd_norm"), 6)


def yearly_stats(spark, sf):
    """Six statistics per (author key, feature) over the yearly means; series are bounded by the years."""
    return series.variability(long_years(spark, sf), [*KEYS4, "feature"], ["year"])


@query("F5_author_table_wide", YL + "SELECT " + K4 + ", " + ", ".join(
    f"max(CASE WHEN feature = '{f}' THEN round(sqrt(variance) / nullif(abs(mean), 0), 6) END) AS {f}_cv, "
    f"max(CASE WHEN feature = '{f}' THEN round(rmssd / nullif(abs(mean), 0), 6) END) AS {f}_rmssd_norm" for f in FEATURES
) + " FROM s GROUP BY ALL")
def f5w(spark, sf):
    return rounded(series.stats_table(yearly_stats(spark, sf), KEYS4, FEATURES, ["cv", "rmssd_norm"]), 6)


MACRO_SQL = """dm AS (SELECT domain, model, year, avg(quantity) AS quantity, avg(price) AS price, avg(discount) AS discount, avg(tax) AS tax
   FROM items GROUP BY ALL),
 dl AS (SELECT domain, model, year, 'quantity' AS feature, quantity AS value FROM dm UNION ALL SELECT domain, model, year, 'price', price FROM dm
   UNION ALL SELECT domain, model, year, 'discount', discount FROM dm UNION ALL SELECT domain, model, year, 'tax', tax FROM dm)"""


@query("F6_macro_variability", f"""WITH {ITEMS_SQL}, {MACRO_SQL},
 d AS (SELECT *, value - lag(value) OVER (PARTITION BY domain, model, feature ORDER BY year) AS d FROM dl)
 SELECT domain, model, feature, coalesce(round(stddev_pop(value) / nullif(avg(value), 0), 8), 0.0) AS cv,
  coalesce(round(sqrt(avg(d * d)) / nullif(avg(value), 0), 8), 0.0) AS rmssd_norm,
  coalesce(round(avg(abs(d)) / nullif(avg(value), 0), 8), 0.0) AS masd_norm FROM d GROUP BY ALL""")
def f6(spark, sf):
    return rounded(macro_variability(spark, sf), 8)


def macro_variability(spark, sf):
    long = unpivot(domain_years(spark, sf), ["domain", "model", "year"], FEATURES)
    df = series.variability(long, ["domain", "model", "feature"], ["year"], mode="macro")
    return df.select("domain", "model", "feature", "cv", "rmssd_norm", "masd_norm")


@query("F6_macro_variability_raw_rows", f"""WITH {EVENTS_SQL},
 d AS (SELECT *, value - lag(value) OVER (PARTITION BY field ORDER BY ts, item) AS d FROM f3)
 SELECT field, count(*) AS n_values, round(stddev_pop(value) / avg(value), 8) AS cv, round(sqrt(avg(d * d)) / avg(value), 8) AS rmssd_norm,
  round(avg(abs(d)) / avg(value), 8) AS masd_norm FROM d GROUP BY ALL""")
def f6r(spark, sf):
    df = event_series(spark, sf).withColumn("minute", F.date_trunc("minute", "ts"))
    df = series.variability(df, ["field"], ["ts", "item"], block="minute", mode="macro")
    return rounded(df.select("field", "n_values", "cv", "rmssd_norm", "masd_norm"), 8)


# ---------------------------------------------------------------------- masking


@query("E8_iqr_bounds", f"""WITH {LONG_SQL} SELECT model, domain, feature, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3
 FROM f1l GROUP BY ALL""")
def e8(spark, sf):
    return rounded(clean.iqr_bounds(clean.group_defaults(long_years(spark, sf)), ["model", "domain", "feature"]).drop("lower", "upper"), 6)


MASK_LONG = """qb AS (SELECT model, domain, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f1l GROUP BY ALL),
 mk AS (SELECT f1l.*, q3 - q1 <> 0 AND (value < q1 - 1.500000001::DOUBLE * (q3 - q1) OR value > q3 + 1.500000001::DOUBLE * (q3 - q1)) AS is_outlier FROM f1l JOIN qb USING (model, domain, feature))"""


def masked_years(spark, sf):
    return clean.mask_outliers(clean.group_defaults(long_years(spark, sf)), ["model", "domain", "feature"])


@query("E9_mask_outliers", f"""WITH {LONG_SQL}, {MASK_LONG} SELECT {K4}, year, feature, CASE WHEN NOT is_outlier THEN round(value, 6) END AS value, is_outlier FROM mk""")
def e9(spark, sf):
    return rounded(masked_years(spark, sf).select(*KEYS4, "year", "feature", "value", "is_outlier"), 6)


@query("E10_outlier_report", f"""WITH {LONG_SQL}, {MASK_LONG} SELECT model, domain, feature, count(*) AS total, count(*) FILTER (is_outlier) AS outliers,
 round(count(*) FILTER (is_outlier) * 100.0 / count(*), 6) AS outlier_pct FROM mk GROUP BY ALL""")
def e10(spark, sf):
    return rounded(clean.outlier_report(masked_years(spark, sf), ["model", "domain", "feature"]), 6)


@query("E11_null_report", f"""WITH {LONG_SQL}, {MASK_LONG} SELECT feature, count(*) FILTER (is_outlier) AS excluded, count(*) AS total,
 round(count(*) FILTER (is_outlier) / count(*), 8) AS excluded_share FROM mk GROUP BY ALL""")
def e11(spark, sf):
    return rounded(series.null_report(masked_years(spark, sf), ["feature"]), 8)


# --------------------------------------------------------------------- geometry

PATH_SQL = """st AS (SELECT {keys}, t, vec, lag(vec) OVER w AS p, lag(vec, 2) OVER w AS pp FROM pt WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
 sd AS (SELECT *, CASE WHEN list_distance(vec, p) <= 1e-12 * sqrt(list_dot_product(vec, vec)) THEN 0 ELSE list_distance(vec, p) END AS dist,
   CASE WHEN list_distance(p, pp) <= 1e-12 * sqrt(list_sum(list_transform(p, lambda x: x * x))) THEN 0 ELSE list_distance(p, pp) END AS pdist,
   list_sum(list_transform(range(1, len(vec) + 1), lambda i: (vec[i] - p[i]) * (p[i] - pp[i]))) AS dp FROM st),
 sc AS (SELECT *, CASE WHEN pp IS NOT NULL THEN dp / nullif(dist * pdist, 0) END AS cosine FROM sd),
 pm AS (SELECT {keys}, avg(dist) AS mean_distance, stddev_pop(dist) AS std_distance, sum(dist) AS path_length, avg(cosine) AS direction_consistency,
   count(*) AS n_years, CASE WHEN count(*) >= 2 THEN CASE WHEN list_distance(min_by(vec, t), max_by(vec, t)) <= 1e-12 * sqrt(list_dot_product(max_by(vec, t), max_by(vec, t)))
     THEN 0 ELSE list_distance(min_by(vec, t), max_by(vec, t)) END END AS net_displacement FROM sc GROUP BY ALL),
 g AS (SELECT *, CASE WHEN net_displacement > 0 THEN path_length / net_displacement WHEN net_displacement = 0 THEN {zero} END AS tortuosity FROM pm)"""


def path_sql(keys, zero="1.0"):
    return PATH_SQL.format(keys=keys, zero=zero)


SUPP_PT = f"WITH {YEARS_SQL}, pt AS (SELECT {K4}, year AS t, [quantity, price, discount, tax] AS vec FROM f1), {path_sql(K4)} "


def supplier_vectors(spark, sf):
    return geometry.feature_vectors(supplier_years(spark, sf), FEATURES).select(*KEYS4, "year", "vec")


def supplier_geometry(spark, sf):
    return geometry.path_metrics(supplier_vectors(spark, sf), KEYS4, ["year"])


GEO_SEL = """round(mean_distance, 3) AS mean_distance, round(std_distance, 3) AS std_distance, round(net_displacement, 3) AS net_displacement,
 round(path_length, 3) AS path_length, round(tortuosity, 5) AS tortuosity, round(direction_consistency, 6) AS direction_consistency, n_years"""


def _geo_round(df):
    df = rounded(df, 3, "mean_distance", "std_distance", "net_displacement", "path_length")
    return rounded(rounded(df, 5, "tortuosity"), 6, "direction_consistency")


@query("F12_supplier_geometry", SUPP_PT + f"SELECT {K4}, {GEO_SEL} FROM g")
def f12(spark, sf):
    return _geo_round(supplier_geometry(spark, sf))


@query("F7_step_distances", SUPP_PT + f"SELECT {K4}, t AS year, round(dist, 3) AS distance FROM sd WHERE p IS NOT NULL")
def f7(spark, sf):
    df = geometry.steps(supplier_vectors(spark, sf), KEYS4, ["year"]).where("distance IS NOT NULL")
    return rounded(df.select(*KEYS4, "year", "distance"), 3)


@query("F8_step_summary", SUPP_PT + f"SELECT {K4}, round(mean_distance, 3) AS mean_distance, round(std_distance, 3) AS std_distance, round(path_length, 3) AS path_length FROM g")
def f8(spark, sf):
    return rounded(supplier_geometry(spark, sf).select(*KEYS4, "mean_distance", "std_distance", "path_length"), 3)


@query("F9_net_displacement", SUPP_PT + f"SELECT {K4}, round(net_displacement, 3) AS net_displacement FROM g")
def f9(spark, sf):
    return rounded(supplier_geometry(spark, sf).select(*KEYS4, "net_displacement"), 3)


ROUND_TRIP = """rt AS (SELECT author_id, year AS t, [CAST(avg(value) AS DOUBLE), CAST(count(*) AS DOUBLE)] AS vec FROM f2 GROUP BY ALL),
 pt AS (SELECT author_id, t, vec FROM rt UNION ALL SELECT author_id, 9999, min_by(vec, t) FROM rt WHERE author_id % 2 = 0 GROUP BY 1)"""


def round_trips(spark, sf):
    """Customer-year vectors; every second customer's path returns to its start (net 0)."""
    y = order_series(spark, sf).groupBy("author_id", F.col("year").alias("t")).agg(
        F.array(F.avg("value"), F.count(F.lit(1)).cast("double")).alias("vec"))
    back = y.where(F.col("author_id") % 2 == 0).groupBy("author_id").agg(F.lit(9999).alias("t"), F.min_by("vec", "t").alias("vec"))
    return y.unionByName(back)


@query("F10_tortuosity_closed_paths", f"""WITH {ORDERS_SQL}, {ROUND_TRIP}, {path_sql('author_id')}
 SELECT author_id, n_years, round(tortuosity, 5) AS tortuosity, round(CASE WHEN net_displacement > 0 THEN tortuosity END, 5) AS tortuosity_or_null FROM g""")
def f10(spark, sf):
    pts = round_trips(spark, sf)
    one = geometry.path_metrics(pts, ["author_id"], ["t"], zero_net=1.0)
    return rounded(one.select("author_id", "n_years", "tortuosity", F.when(F.col("net_displacement") > 0, F.col("tortuosity")).alias("tortuosity_or_null")), 5)


@query("F11_direction_consistency", f"""WITH {ORDERS_SQL}, {ROUND_TRIP}, {path_sql('author_id')}
 SELECT author_id, n_years, round(direction_consistency, 6) + 0.0 AS direction_consistency FROM g""")
def f11(spark, sf):
    df = geometry.path_metrics(round_trips(spark, sf), ["author_id"], ["t"])
    return rounded(df.select("author_id", "n_years", "direction_consistency"), 6)


VEC_YEARS = """ye AS (SELECT author_id, year, i, avg(x) AS m FROM (SELECT author_id, year, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vecs) GROUP BY ALL),
 pt AS (SELECT author_id, year AS t, list(m ORDER BY i) AS vec FROM ye GROUP BY ALL)"""
GEO6 = ", ".join(f"round({m}, 6) AS {m}" for m in geometry.METRICS)


@query("F12_embedding_geometry", f"WITH {VECTORS_SQL}, {VEC_YEARS}, {path_sql('author_id')} SELECT author_id, {GEO6}, n_years FROM g")
def f12e(spark, sf):
    return rounded(embedding_geometry(spark, sf), 6)


def embedding_geometry(spark, sf):
    yearly = geometry.yearly_vectors(vector_items(spark, sf), ["author_id", "year"])
    return geometry.path_metrics(yearly, ["author_id"], ["year"])


@query("F13_scalar_feature_geometry", SUPP_PT + f"SELECT {K4}, {GEO_SEL} FROM g")
def f13(spark, sf):
    """All scalar features as they are; ``linear.zscore`` before ``feature_vectors`` gives the scaled space."""
    points = geometry.feature_vectors(supplier_years(spark, sf), FEATURES)
    return _geo_round(geometry.path_metrics(points, KEYS4, ["year"]))


NULL_TIMES = f"""WITH {EVENTS_SQL}, nt AS (SELECT author_id, field, value, item, CASE WHEN item % 11 <> 0 THEN ts END AS ts FROM f3),
 d AS (SELECT *, value - lag(value) OVER (PARTITION BY {EV} ORDER BY ts NULLS LAST, item) AS d FROM nt WHERE value IS NOT NULL)
 SELECT author_id, field, count(*) AS n_values, round(sqrt(avg(d * d)), 6) AS rmssd, round(avg(abs(d)), 6) AS masd FROM d GROUP BY ALL"""


@query("F2_null_times_last", NULL_TIMES)
def f2_null(spark, sf):
    """Items without a time come after all others, in blocks and across them."""
    df = event_series(spark, sf).withColumn("ts", F.when(F.col("item") % 11 != 0, F.col("ts"))).withColumn("day", F.to_date("ts"))
    out = series.variability(df, ["author_id", "field"], ["ts", "item"], block="day")
    return rounded(out.select("author_id", "field", "n_values", "rmssd", "masd"), 6)


@query("F14_document_path", f"""WITH {VECTORS_SQL}, pt AS (SELECT author_id, item AS t, vec FROM vecs), {path_sql('author_id', 'NULL')}
 SELECT author_id, round(mean_distance, 6) AS mean_yearly_distance, round(std_distance, 6) AS std_yearly_distance, round(path_length, 6) AS path_length,
  round(net_displacement, 6) AS net_displacement, round(tortuosity, 6) AS tortuosity, n_years FROM g WHERE n_years >= 2""")
def f14(spark, sf):
    df = vector_items(spark, sf).withColumn("block", F.floor(F.col("item") / 64))
    return rounded(geometry.document_path(df, ["author_id"], ["item"], "block"), 6)


@query("F15_macro_trajectory_row", f"""WITH {ITEMS_SQL}, {MACRO_SQL},
 d AS (SELECT *, value - lag(value) OVER (PARTITION BY domain, model, feature ORDER BY year) AS d FROM dl),
 v AS (SELECT domain, model, feature, stddev_pop(value) / avg(value) AS cv, sqrt(avg(d * d)) / avg(value) AS rn, avg(abs(d)) / avg(value) AS mn FROM d GROUP BY ALL),
 vw AS (SELECT domain, model, """ + ", ".join(
    f"max(CASE WHEN feature = '{f}' THEN round(cv, 7) END) AS {f}_cv, max(CASE WHEN feature = '{f}' THEN round(rn, 7) END) AS {f}_rmssd_norm, "
    f"max(CASE WHEN feature = '{f}' THEN round(mn, 7) END) AS {f}_masd_norm" for f in FEATURES) + f""" FROM v GROUP BY ALL),
 pt AS (SELECT domain, model, year AS t, [quantity, price, discount, tax] AS vec FROM dm), {path_sql('domain, model')},
 c AS (SELECT domain, model, count(*) AS sample_count, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM items GROUP BY ALL)
 SELECT domain, model, vw.* EXCLUDE (domain, model), round(mean_distance, 3) AS ce_mean_distance, round(std_distance, 3) AS ce_std_distance,
  round(net_displacement, 3) AS ce_net_displacement, round(path_length, 3) AS ce_path_length, round(tortuosity, 5) AS ce_tortuosity,
  n_years, sample_count, years FROM vw JOIN g USING (domain, model) JOIN c USING (domain, model)""")
def f15(spark, sf):
    var = series.stats_table(macro_variability(spark, sf), ["domain", "model"], FEATURES, ["cv", "rmssd_norm", "masd_norm"])
    pts = geometry.feature_vectors(domain_years(spark, sf), FEATURES)
    geo = geometry.path_metrics(pts, ["domain", "model"], ["year"], prefix="ce_").drop("ce_direction_consistency")
    counts = (
        with_supplier_domain(spark, sf, supplier_items(spark, sf).groupBy("author_id", "model", "year").agg(F.count(F.lit(1)).alias("n")))
        .groupBy("domain", "model").agg(
            F.sum("n").alias("sample_count"), F.array_join(F.sort_array(F.collect_set("year")), ",").alias("years"))
    )
    row = var.join(geo, ["domain", "model"]).join(counts, ["domain", "model"]).withColumnRenamed("ce_n_years", "n_years")
    row = rounded(row, 3, "ce_mean_distance", "ce_std_distance", "ce_net_displacement", "ce_path_length")
    return rounded(rounded(row, 5, "ce_tortuosity"), 7, *[f"{f}_{s}" for f in FEATURES for s in ("cv", "rmssd_norm", "masd_norm")])


@query("E32_years_covered", f"""WITH {ORDERS_SQL} SELECT domain, author_id, count(DISTINCT year) AS n_years,
 string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM f2 GROUP BY ALL""")
def e32(spark, sf):
    years = F.sort_array(F.collect_set("year"))
    return order_series(spark, sf).groupBy("domain", "author_id").agg(
        F.size(years).cast("bigint").alias("n_years"), F.array_join(years, ",").alias("years"))


@query("F16_pair_distances", f"""WITH {VECTORS_SQL},
 p AS (SELECT a.author_id, count(*) AS n_pairs, avg(list_distance(a.vec, b.vec) ** 2) AS msd FROM vecs a JOIN vecs b ON a.author_id = b.author_id AND a.item < b.item GROUP BY 1),
 n AS (SELECT author_id, count(*) AS n_items FROM vecs GROUP BY 1)
 SELECT author_id, n_items, n_pairs, round(msd, 6) AS mean_sq_distance FROM n JOIN p USING (author_id)""")
def f16(spark, sf):
    return rounded(geometry.pair_spread(vector_items(spark, sf), ["author_id"]), 6)


@query("F16_adjacent_distances", f"""WITH {VECTORS_SQL} SELECT author_id, item, round(list_distance(vec, lag(vec) OVER (PARTITION BY author_id ORDER BY item)), 6) AS distance
 FROM vecs QUALIFY lag(item) OVER (PARTITION BY author_id ORDER BY item) IS NOT NULL""")
def f16a(spark, sf):
    df = vector_items(spark, sf).withColumn("block", F.floor(F.col("item") / 64))
    df = geometry.adjacent_distances(df, ["author_id"], ["item"], "block").where("distance IS NOT NULL")
    return rounded(df.select("author_id", "item", "distance"), 6)


@query("F19_first_value", f"""WITH {EVENTS_SQL}, {MASK_SQL} SELECT author_id, field, round(min_by(value, item), 6) AS first_value FROM mk WHERE value IS NOT NULL GROUP BY ALL""")
def f19(spark, sf):
    df = masked_events(spark, sf).where("value IS NOT NULL").groupBy("author_id", "field").agg(F.min_by("value", "item").alias("first_value"))
    return rounded(df, 6)


@query("G1_time_order", f"""WITH {ORDERS_SQL}, m AS (SELECT *, CASE WHEN item % 9 = 0 THEN NULL ELSE year END AS y FROM f2)
 SELECT author_id, item, row_number() OVER (PARTITION BY author_id ORDER BY y ASC NULLS LAST, item) AS position FROM m""")
def g1(spark, sf):
    df = order_series(spark, sf).withColumn("y", F.when(F.col("item") % 9 != 0, F.col("year")))
    return series.position(df, ["author_id"], ["y", "item"], "y").select("author_id", "item", "position")
