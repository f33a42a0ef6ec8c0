"""Queries for yearly effects, trends and rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import features as feat
from wayline.functions.columns import rounded
from wayline.functions.pvalues import trend_class
from wayline.operators import compare, ranks, trend
from wayline.plans.registry import query
from wayline.plans.comparison import UNI, is_human, unified_long
from wayline.sources.bindings import (
    EVENTS_SQL, FEATURES, ITEMS_SQL, event_series, supplier_items, table, with_supplier_domain,
)



def t_p_sql(t: str, dof: str) -> str:
    """Two-sided Student p for whole degrees of freedom by its finite trigonometric sums."""
    th = f"atan(abs({t}) / sqrt({dof}))"
    even = f"sin({th}) * list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * cos({th}) ** (2 * k)))"
    odd = f"2 / pi() * ({th} + coalesce(sin({th}) * list_sum(list_transform(range(0, CAST(({dof} - 1) // 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * cos({th}) ** (2 * k + 1))), 0))"
    return f"(1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END)"


def normal_p_sql(z: str) -> str:
    """Two-sided normal p by the error function's power series (for moderate z)."""
    return f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln({z} / sqrt(2::DOUBLE)) - lgamma(i + 1)) / (2 * i + 1))))"


LAYER = {"Size": ["quantity", "price"], "Rate": ["discount", "tax"]}
LAYER_SQL = "CASE WHEN feature IN ('quantity', 'price') THEN 'Size' ELSE 'Rate' END"
IL = f"""{ITEMS_SQL}, il AS (SELECT domain, model, year, 'quantity' AS feature, quantity AS v FROM items UNION ALL SELECT domain, model, year, 'price', price FROM items
  UNION ALL SELECT domain, model, year, 'discount', discount FROM items UNION ALL SELECT domain, model, year, 'tax', tax FROM items),
 mo AS (SELECT domain, model, feature, year, count(*) AS n, avg(v) AS mean, var_samp(v) AS va FROM il GROUP BY ALL)"""
EFF = IL + """, ye AS (SELECT l.domain, l.model, l.feature, l.year, h.mean AS human_mean, l.mean AS llm_mean, h.mean - l.mean AS mean_difference, h.n AS human_n, l.n AS llm_n,
   sqrt(((h.n - 1) * h.va + (l.n - 1) * l.va) / nullif(h.n + l.n - 2, 0)) AS ps FROM mo h JOIN mo l USING (domain, feature, year) WHERE h.model = 'N' AND l.model <> 'N'),
 yd AS (SELECT *, CASE WHEN ps = 0 THEN 0 ELSE mean_difference / ps END AS cohens_d, coalesce(mean_difference / nullif(ps * sqrt(1.0 / human_n + 1.0 / llm_n), 0), 0) AS t_statistic FROM ye)"""


def yearly_moments(spark, sf):
    """Moments per (domain, model, feature, year); combined in the map tasks, so a large domain is no hot group."""
    return trend.moments(with_supplier_domain(spark, sf, supplier_items(spark, sf)), ["domain", "model", "year"], FEATURES)


def effects(spark, sf):
    return trend.yearly_effects(yearly_moments(spark, sf), ["domain", "feature"], is_human())


@query("E4_yearly_mean_per_source", f"WITH {IL} SELECT domain, model, feature, year, round(mean, 6) AS mean, n FROM mo")
def e4(spark, sf):
    return rounded(yearly_moments(spark, sf).select("domain", "model", "feature", "year", "mean", "n"), 6)


@query("E5_static_mean_per_label", f"WITH {IL} SELECT model, feature, round(avg(v), 5) AS mean, count(*) AS n FROM il GROUP BY ALL")
def e5(spark, sf):
    m = trend.moments(supplier_items(spark, sf).join(table(spark, sf, "supplier"), F.col("author_id") == F.col("s_suppkey"), "left_semi"), ["model"], FEATURES)
    return rounded(m.select("model", "feature", "mean", "n"), 5)


DIFF = IL + ", df AS (SELECT l.domain, l.feature, l.model, l.year, h.mean - l.mean AS difference FROM mo h JOIN mo l USING (domain, feature, year) WHERE h.model = 'N' AND l.model <> 'N')"


def differences(spark, sf):
    return trend.yearly_differences(yearly_moments(spark, sf), ["domain", "feature"], is_human())


@query("D10_yearly_difference", f"WITH {DIFF} SELECT domain, feature, model, year, round(difference, 5) + 0.0 AS difference FROM df")
def d10(spark, sf):
    return rounded(differences(spark, sf), 5)


@query("E28_min_max_scaled_difference", f"""WITH {DIFF}, m AS (SELECT *, min(abs(difference)) OVER w AS lo, max(abs(difference)) OVER w AS hi FROM df WINDOW w AS (PARTITION BY domain, feature, model))
 SELECT domain, feature, model, year, round(CASE WHEN hi - lo = 0 THEN 0 ELSE (abs(difference) - lo) / (hi - lo) END, 6) AS scaled FROM m""")
def e28(spark, sf):
    df = trend.min_max_scaled(differences(spark, sf), ["domain", "feature", "model"], F.col("difference"))
    return rounded(df.drop("difference"), 6)


CONV = DIFF + """, cv AS (SELECT domain, feature, model, regr_slope(abs(difference), year) AS slope_abs FROM df GROUP BY ALL),
 ct AS (SELECT *, CASE WHEN slope_abs IS NULL THEN 'insufficient' WHEN slope_abs < 0 THEN 'converging' WHEN slope_abs > 0 THEN 'diverging' ELSE 'flat' END AS trend FROM cv)"""


def convergence(spark, sf):
    return trend.convergence(differences(spark, sf), ["domain", "feature", "model"])


@query("I9_slope_of_absolute_difference", f"WITH {CONV} SELECT domain, feature, model, round(slope_abs, 6) + 0.0 AS slope_abs, trend FROM ct")
def i9(spark, sf):
    return rounded(convergence(spark, sf), 6)


def layered(spark, sf):
    return feat.with_layer(convergence(spark, sf), feat.feature_dim(spark, LAYER))


LSUM = """SELECT {g} layer, count(*) AS total, count(*) FILTER (trend = 'converging') AS converging, count(*) FILTER (trend = 'diverging') AS diverging,
 count(*) FILTER (trend = 'insufficient') AS insufficient, round(count(*) FILTER (trend = 'converging') / count(*), 3) AS convergence_ratio FROM (SELECT *, """ + LAYER_SQL + """ AS layer FROM ct) GROUP BY ALL"""


@query("E20_layer_summary", f"WITH {CONV} " + LSUM.format(g="domain,"))
def e20(spark, sf):
    return trend.layer_summary(layered(spark, sf), ["domain"])


@query("I10_convergence_per_domain_and_model", f"WITH {CONV} " + LSUM.format(g="domain, model,"))
def i10(spark, sf):
    return trend.layer_summary(layered(spark, sf), ["domain", "model"])


@query("I5_cohens_d", f"WITH {EFF} SELECT domain, model, feature, year, round(cohens_d, 7) + 0.0 AS cohens_d FROM yd")
def i5(spark, sf):
    return rounded(effects(spark, sf).select("domain", "model", "feature", "year", "cohens_d"), 7)


@query("I6_student_t_statistic_part", f"WITH {EFF} SELECT domain, model, feature, year, round(t_statistic, 6) + 0.0 AS t_statistic FROM yd")
def i6(spark, sf):
    return rounded(effects(spark, sf).select("domain", "model", "feature", "year", "t_statistic"), 6)


@query("I6_student_t_p_value", f"""WITH {EFF} SELECT domain, model, feature, year, round(t_statistic, 6) + 0.0 AS t_statistic, round({t_p_sql('t_statistic', '(human_n + llm_n - 2)')}, 6) AS p_value FROM yd""")
def i6p(spark, sf):
    return rounded(effects(spark, sf).select("domain", "model", "feature", "year", "t_statistic", "p_value"), 6)


@query("I7_yearly_effects_without_p", f"""WITH {EFF} SELECT domain, model, feature, year, round(human_mean, 6) AS human_mean, round(llm_mean, 6) AS llm_mean, round(mean_difference, 6) + 0.0 AS mean_difference,
 round(cohens_d, 6) + 0.0 AS cohens_d, round(t_statistic, 6) + 0.0 AS t_statistic, human_n, llm_n FROM yd""")
def i7(spark, sf):
    return rounded(effects(spark, sf).drop("p_value"), 6, "human_mean", "llm_mean", "mean_difference", "cohens_d", "t_statistic")


TR = EFF + """, ym AS (SELECT domain, feature, model, year, 'mean_difference' AS measure, abs(mean_difference) AS v FROM yd UNION ALL SELECT domain, feature, model, year, 'cohens_d', abs(cohens_d) FROM yd),
 tr AS (SELECT domain, feature, model, measure, CASE WHEN var_pop(v) = 0 THEN 0 ELSE regr_slope(v, year) END AS slope, CASE WHEN var_pop(v) = 0 THEN 0 ELSE corr(v, year) END AS correlation FROM ym GROUP BY ALL HAVING count(*) >= 2),
 tp AS (SELECT *, correlation * sqrt(5 / nullif(1 - correlation ** 2, 0)) AS t FROM tr), tq AS (SELECT *, """ + t_p_sql("t", "5") + """ AS p FROM tp)"""


def effect_trend_table(spark, sf):
    return trend.effect_trends(effects(spark, sf), ["domain", "feature", "model"])


@query("I8_effect_trends_without_p", f"""WITH {TR} SELECT domain, feature, model, measure, round(slope, 6) + 0.0 AS slope, round(correlation, 6) AS correlation,
 CASE WHEN slope < 0 THEN 'converging' WHEN slope > 0 THEN 'diverging' ELSE 'stable' END AS trend FROM tr""")
def i8(spark, sf):
    return rounded(effect_trend_table(spark, sf).drop("p_value", "significant"), 6)


SIG = """SELECT domain, feature, model, measure, round(slope, 6) + 0.0 AS slope, round(correlation, 6) AS correlation, round(p, 6) AS p_value, p < 0.05 AS significant,
 CASE WHEN slope < 0 THEN 'converging' WHEN slope > 0 THEN 'diverging' ELSE 'stable' END AS trend FROM tq"""


@query("I8_effect_trend_significance", f"WITH {TR} {SIG}")
def i8p(spark, sf):
    return rounded(effect_trend_table(spark, sf), 6)


@query("G7_significant_trends_in_order", f"WITH {TR} {SIG} WHERE p < 0.05")
def g7(spark, sf):
    return rounded(effect_trend_table(spark, sf).where("significant").orderBy("trend", "p_value", "domain", "feature", "model", "measure"), 6)


DOMAINS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("H6_trend_code_pivot", f"""WITH {TR}, c AS (SELECT feature, domain, model, CASE WHEN slope < 0 THEN 1.0::DOUBLE WHEN slope > 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END * CASE WHEN p < 0.05 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS code
   FROM tq WHERE measure = 'mean_difference') SELECT """ + LAYER_SQL + " AS layer, feature, model, " + ", ".join(
    f"coalesce(max(CASE WHEN domain = '{d}' THEN code END), 0) AS \"{d}\"" for d in DOMAINS) + " FROM c GROUP BY ALL")
def h6(spark, sf):
    from wayline.operators.report import trend_code_pivot

    t = effect_trend_table(spark, sf).where("measure = 'mean_difference'")
    return trend_code_pivot(feat.with_layer(t, feat.feature_dim(spark, LAYER)), DOMAINS)


ACC = """ac AS (SELECT c_mktsegment AS domain, CAST(year(o_orderdate) AS INTEGER) AS year, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy,
   avg(CASE WHEN o_orderpriority < '3' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS other FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def yearly_rates(spark, sf):
    """Rate per (domain, year) standing in for a yearly accuracy table."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("domain"), F.year("o_orderdate").alias("year")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.when(F.col("o_orderpriority") < "3", 1.0).otherwise(0.0)).alias("other"))


@query("I11_accuracy_trend_without_p", f"""WITH {ACC} SELECT domain, round(regr_slope(accuracy, year), 8) + 0.0 AS slope, round(regr_intercept(accuracy, year), 4) AS intercept, round(corr(accuracy, year), 7) AS correlation,
 round(sqrt((1 - corr(accuracy, year) ** 2) * var_pop(accuracy) / var_pop(year) / (count(*) - 2)), 8) AS std_err, CASE WHEN regr_slope(accuracy, year) < 0 THEN 'decreasing' WHEN regr_slope(accuracy, year) > 0 THEN 'increasing' ELSE 'stable' END AS trend FROM ac GROUP BY 1""")
def i11(spark, sf):
    return accuracy_trend(spark, sf).drop("p_value", "n")


def accuracy_trend(spark, sf):
    t = trend.regress(yearly_rates(spark, sf), ["domain"], "year", F.col("accuracy"))
    t = t.withColumn("trend", trend_class(F.col("slope"), "decreasing", "increasing", "stable"))
    return rounded(rounded(rounded(t, 8, "slope", "std_err"), 4, "intercept"), 7, "correlation", "p_value")


@query("I11_accuracy_trend_p_value", f"""WITH {ACC}, r AS (SELECT domain, count(*) AS n, regr_slope(accuracy, year) AS slope, regr_intercept(accuracy, year) AS i, corr(accuracy, year) AS c, var_pop(accuracy) AS vy, var_pop(year) AS vx FROM ac GROUP BY 1),
 t AS (SELECT *, c * sqrt((n - 2) / (1 - c * c)) AS t, n - 2 AS dof FROM r)
 SELECT domain, n, round(slope, 8) + 0.0 AS slope, round(i, 4) AS intercept, round(c, 7) AS correlation, round({t_p_sql('t', 'dof')}, 7) AS p_value, round(sqrt((1 - c * c) * vy / vx / dof), 8) AS std_err,
  CASE WHEN slope < 0 THEN 'decreasing' WHEN slope > 0 THEN 'increasing' ELSE 'stable' END AS trend FROM t""")
def i11p(spark, sf):
    return accuracy_trend(spark, sf)


@query("D12_experiment_delta", f"WITH {ACC} SELECT domain, year, round(accuracy, 8) AS accuracy, round(other, 8) AS other, round(accuracy - other, 8) + 0.0 AS delta FROM ac")
def d12(spark, sf):
    r = yearly_rates(spark, sf)
    a, b = r.select("domain", "year", "accuracy"), r.select("domain", "year", "other")
    return rounded(a.join(b, ["domain", "year"]).withColumn("delta", F.col("accuracy") - F.col("other")), 8)


@query("E30_mean_accuracy_per_year", f"WITH {ACC} SELECT year, round(avg(accuracy), 8) AS accuracy, count(*) AS n_domains FROM ac GROUP BY 1")
def e30(spark, sf):
    return rounded(yearly_rates(spark, sf).groupBy("year").agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n_domains")), 8)


# -------------------------------------------------------------------- rank tests


def purchases_and_views(spark, sf):
    """Events of two types, compared by value per day; many users, few ties."""
    side = F.when(F.col("field") == "click", "click").otherwise("view")
    return event_series(spark, sf).withColumns({"field": side, "grp": F.pmod("author_id", F.lit(5)).cast("int")})


TWO = EVENTS_SQL + ", tv AS (SELECT * REPLACE (CASE WHEN field = 'click' THEN 'click' ELSE 'view' END AS field), CAST(author_id % 5 AS INTEGER) AS grp FROM f3)"
MWU = """r AS (SELECT grp, field, value, rank() OVER (PARTITION BY grp ORDER BY value) + (count(*) OVER (PARTITION BY grp, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY grp, value) AS t FROM tv),
 q AS (SELECT grp, count(*) FILTER (field = 'click') AS n1, count(*) FILTER (field = 'view') AS n2, CAST(sum(rk) FILTER (field = 'click') AS DOUBLE) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY 1),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))) AS sd FROM q)"""


@query("I12_mann_whitney_u_without_p", f"WITH {TWO}, {MWU} SELECT grp, n1, n2, round(u, 3) AS u, round(greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sd, 6) AS z FROM u")
def i12(spark, sf):
    return rounded(rounded(mann_whitney(spark, sf).drop("p_value"), 3, "u"), 6, "z")


def mann_whitney(spark, sf):
    return ranks.mann_whitney(purchases_and_views(spark, sf), ["grp"], "value", F.col("field") == "click")


@query("I12_mann_whitney_p_value", f"""WITH {TWO}, {MWU}, zz AS (SELECT *, greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sd AS z FROM u)
 SELECT grp, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round({normal_p_sql('z')}, 6) AS p_value FROM zz""")
def i12p(spark, sf):
    return rounded(mann_whitney(spark, sf), 6)


def word_lengths_by_quality(spark, sf):
    from wayline.functions.text import tokens

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("lang", "quality", F.size(tokens(F.col("text"))).alias("value"))


@query("I12_mann_whitney_u_with_ties", """WITH tv AS (SELECT lang AS grp, CASE WHEN quality = 1 THEN 'click' ELSE 'view' END AS field, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS value FROM documents JOIN labels USING (doc_id)), """
       + MWU + " SELECT grp AS lang, n1, n2, round(u, 3) AS u, round(greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sd, 6) AS z FROM u")
def i12t(spark, sf):
    df = ranks.mann_whitney(word_lengths_by_quality(spark, sf), ["lang"], "value", F.col("quality") == 1)
    return rounded(rounded(df.drop("p_value"), 3, "u"), 6, "z")


@query("I13_kolmogorov_smirnov_d_without_p", f"""WITH {TWO}, s AS (SELECT grp, count(*) FILTER (field = 'click') AS n1, count(*) FILTER (field = 'view') AS n2 FROM tv GROUP BY 1),
 c AS (SELECT grp, value, sum(CASE WHEN field = 'click' THEN 1 ELSE 0 END) OVER w AS c1, sum(CASE WHEN field = 'view' THEN 1 ELSE 0 END) OVER w AS c2 FROM tv WINDOW w AS (PARTITION BY grp ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT grp, n1, n2, round(max(abs(c1 / n1 - c2 / n2)), 8) AS d FROM c JOIN s USING (grp) GROUP BY ALL""")
def i13(spark, sf):
    return rounded(kolmogorov(spark, sf).drop("p_value"), 8)


def kolmogorov(spark, sf):
    return ranks.kolmogorov_smirnov(purchases_and_views(spark, sf), ["grp"], "value", F.col("field") == "click")


@query("I13_kolmogorov_smirnov_p_value", f"""WITH {TWO}, s AS (SELECT grp, count(*) FILTER (field = 'click') AS n1, count(*) FILTER (field = 'view') AS n2 FROM tv GROUP BY 1),
 c AS (SELECT grp, value, sum(CASE WHEN field = 'click' THEN 1 ELSE 0 END) OVER w AS c1, sum(CASE WHEN field = 'view' THEN 1 ELSE 0 END) OVER w AS c2 FROM tv WINDOW w AS (PARTITION BY grp ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 d AS (SELECT grp, n1, n2, max(abs(c1 / n1 - c2 / n2)) AS d FROM c JOIN s USING (grp) GROUP BY ALL), l AS (SELECT *, d * sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE)) AS l FROM d)
 SELECT grp, n1, n2, round(d, 6) AS d, round(least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * l * l)))), 6) AS p_value FROM l""")
def i13p(spark, sf):
    df = ranks.kolmogorov_smirnov(purchases_and_views(spark, sf), ["grp"], "value", F.col("field") == "click", limit=True)
    return rounded(df, 6)


PER_USER = EVENTS_SQL + """, tv AS (SELECT author_id AS grp, CASE WHEN field = 'click' THEN 'click' ELSE 'view' END AS field, value FROM f3)"""


def per_user(spark, sf):
    """Events of two types for each user: small samples."""
    return event_series(spark, sf).select(F.col("author_id").alias("grp"), (F.col("field") == "click").alias("click"), "value")


def _counted_sql() -> str:
    """P(U <= u) by counting: one factor (1 - q^(b + i)) / (1 - q^i) of the partitions' polynomial after the other, cut at u."""
    steps = ""
    for i in range(1, 9):
        cut = f"list_transform(range(0, j + 1), lambda t: w[t + 1] - CASE WHEN t >= b + {i} THEN w[t - b - {i} + 1] ELSE 0 END)"
        steps += f""", d{i} AS (SELECT * EXCLUDE (w), CASE WHEN a < {i} THEN w ELSE {cut} END AS w FROM w{i - 1}),
 w{i} AS (SELECT * EXCLUDE (w), CASE WHEN a < {i} THEN w ELSE list_transform(range(0, j + 1), lambda t: list_sum(list_transform(range(0, t // {i} + 1), lambda s: w[t - s * {i} + 1]))) END AS w FROM d{i})"""
    return steps


@query("I12_exact_p_per_user", f"""WITH {PER_USER}, {MWU}, zz AS (SELECT *, greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sd AS z FROM u WHERE n1 > 0 AND n2 > 0),
 w0 AS (SELECT grp, n1, n2, u, z, ties, least(n1, n2) AS a, greatest(n1, n2) AS b, CAST(least(u, n1 * n2 - u) AS BIGINT) AS j, list_transform(range(0, CAST(least(u, n1 * n2 - u) AS BIGINT) + 1), lambda t: CASE WHEN t = 0 THEN 1::DOUBLE ELSE 0 END) AS w FROM zz){_counted_sql()}
 SELECT grp, n1, n2, u, round(CASE WHEN ties = 0 AND a <= 8 THEN least(1, 2 * list_sum(w) / round(exp(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1)))) ELSE {normal_p_sql('greatest(z, 1e-12)')} END, 5) AS p_value FROM w8""")
def i12e(spark, sf):
    df = ranks.mann_whitney(per_user(spark, sf), ["grp"], "value", F.col("click"))
    return rounded(df.where("n1 > 0 AND n2 > 0").drop("z"), 5, "p_value")


@query("I13_exact_p_per_user", f"""WITH RECURSIVE {PER_USER}, s AS (SELECT grp, count(*) FILTER (field = 'click') AS n1, count(*) FILTER (field = 'view') AS n2 FROM tv GROUP BY 1),
 c AS (SELECT grp, value, sum(CASE WHEN field = 'click' THEN 1 ELSE 0 END) OVER w AS c1, sum(CASE WHEN field = 'view' THEN 1 ELSE 0 END) OVER w AS c2 FROM tv WINDOW w AS (PARTITION BY grp ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 d AS (SELECT grp, n1, n2, CAST(max(abs(c1 * n2 - c2 * n1)) AS BIGINT) AS h FROM c JOIN s USING (grp) WHERE n1 > 0 AND n2 > 0 GROUP BY ALL),
 p AS (SELECT grp, n1, n2, h, 0::BIGINT AS i, list_transform(range(0, n2 + 1), lambda j: CASE WHEN j * n1 < h THEN 1::DOUBLE ELSE 0 END) AS w FROM d
  UNION ALL SELECT grp, n1, n2, h, i + 1, list_transform(range(0, n2 + 1), lambda j: CASE WHEN abs((i + 1) * n2 - j * n1) < h THEN
   list_sum(list_transform(range(0, j + 1), lambda t: CASE WHEN abs((i + 1) * n2 - t * n1) < h THEN w[t + 1] ELSE 0 END)) * (i + 1) / (n2 + i + 1) ELSE 0 END) FROM p WHERE i < n1)
 SELECT grp, n1, n2, round(h / (n1 * n2)::DOUBLE, 8) AS d, round(CASE WHEN h = 0 THEN 1 ELSE 1 - w[n2 + 1] END, 7) AS p_value FROM p WHERE i = n1""")
def i13e(spark, sf):
    df = ranks.kolmogorov_smirnov(per_user(spark, sf), ["grp"], "value", F.col("click"))
    return rounded(rounded(df.where("n1 > 0 AND n2 > 0"), 8, "d"), 7, "p_value")


@query("I18_effect_table_moments_part", UNI + """, z AS (SELECT feature, avg(value) FILTER (model = 'N') AS hm, avg(value) FILTER (model <> 'N') AS lm, stddev_pop(value) FILTER (model = 'N') AS hs,
   median(value) FILTER (model = 'N') AS hmed FROM ul WHERE feature LIKE 'tfidf%' AND value IS NOT NULL GROUP BY 1)
 SELECT feature, round(hm, 3) + 0.0 AS human_mean, round(lm, 3) + 0.0 AS llm_mean, round(hs, 3) AS human_std, round(hmed, 3) + 0.0 AS human_median FROM z""")
def i18(spark, sf):
    rows = unified_long(spark, sf).where(F.col("feature").startswith("tfidf"))
    df = compare.descriptive_comparison(rows, ["feature"], is_human())
    return rounded(df.select("feature", "human_mean", "llm_mean", "human_std", "human_median"), 3)


@query("I18_effect_table")
def i18f(spark, sf):
    rows = unified_long(spark, sf).where(F.col("feature").startswith("tfidf") & F.col("value").isNotNull())
    d = compare.descriptive_comparison(rows, ["feature"], is_human())
    u = ranks.mann_whitney(rows, ["feature"], "value", is_human()).select("feature", "u", F.col("p_value").alias("mw_p"))
    k = ranks.kolmogorov_smirnov(rows, ["feature"], "value", is_human()).select("feature", "d", F.col("p_value").alias("ks_p"))
    return rounded(d.join(u, "feature").join(k, "feature"), 4)


AUC_SQL = f"""WITH {TWO}, r AS (SELECT grp, field, rank() OVER (PARTITION BY grp ORDER BY value) + (count(*) OVER (PARTITION BY grp, value) - 1) / 2.0 AS rk FROM tv),
 q AS (SELECT grp, count(*) FILTER (field = 'click') AS p, count(*) FILTER (field = 'view') AS n, CAST(sum(rk) FILTER (field = 'click') AS DOUBLE) AS r1 FROM r GROUP BY 1)
 SELECT grp, p AS positives, n AS negatives, round((r1 - p * (p + 1) / 2.0) / (p * n), 8) AS auc FROM q"""


@query("K11_roc_auc", AUC_SQL)
def k11(spark, sf):
    return rounded(ranks.roc_auc(purchases_and_views(spark, sf), ["grp"], "value", F.col("field") == "click"), 8)


def scored_events(spark, sf):
    df = purchases_and_views(spark, sf).withColumn("fold", F.pmod("item", F.lit(5)).cast("int"))
    return df.select("grp", "fold", F.floor("value").alias("score"), (F.col("field") == "click").alias("pos"))


SC = TWO + ", sc AS (SELECT grp, CAST(item % 5 AS INTEGER) AS fold, CAST(floor(value) AS BIGINT) AS score, field = 'click' AS pos FROM tv), pn AS (SELECT grp, fold, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM sc GROUP BY ALL)"
PT = SC + """, dv AS (SELECT grp, fold, score, count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b FROM sc GROUP BY ALL),
 cu AS (SELECT grp, fold, score, CAST(sum(a) OVER w AS BIGINT) AS tp, CAST(sum(b) OVER w AS BIGINT) AS fp, p, n FROM dv JOIN pn USING (grp, fold) WINDOW w AS (PARTITION BY grp, fold ORDER BY score DESC))"""


@query("K12_roc_points", f"WITH {PT} SELECT grp, fold, score AS threshold, round(fp / n, 8) AS fpr, round(tp / p, 8) AS tpr FROM cu")
def k12(spark, sf):
    s = ranks.roc_segments(scored_events(spark, sf), ["grp", "fold"], "score", F.col("pos"))
    return rounded(ranks.roc_points(s, ["grp", "fold"]), 8)


@query("K12_mean_roc_grid", f"""WITH {PT}, al AS (SELECT grp, fold, tp, fp, p, n FROM cu UNION ALL SELECT grp, fold, 0, 0, p, n FROM pn),
 sg AS (SELECT *, lead(tp) OVER w AS tp2, lead(fp) OVER w AS fp2 FROM al WINDOW w AS (PARTITION BY grp, fold ORDER BY fp, tp)),
 gr AS (SELECT grp, fold, i, CASE WHEN i = 0 THEN 0 ELSE (tp + (i * n / 99.0::DOUBLE - fp) * (tp2 - tp) / (fp2 - fp)) / p END AS tpr FROM sg JOIN range(99) r(i) ON i * n >= fp * 99 AND i * n < fp2 * 99 WHERE fp2 > fp
   UNION ALL SELECT grp, fold, 99, 1.0 FROM pn)
 SELECT grp, round(i / 99.0::DOUBLE, 8) AS fpr, round(avg(tpr), 8) AS mean_tpr, round(stddev_pop(tpr), 8) AS std_tpr FROM gr GROUP BY grp, i""")
def k12m(spark, sf):
    s = ranks.roc_segments(scored_events(spark, sf), ["grp", "fold"], "score", F.col("pos"))
    return rounded(ranks.mean_roc(s, ["grp"], "fold"), 8)
