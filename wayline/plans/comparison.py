"""Queries for matched comparison and tests on aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import features as feat
from wayline.functions.columns import null_safe_equal, rounded, unpivot
from wayline.operators import compare, geometry, profile
from wayline.plans.registry import query
from wayline.plans.trajectory import K4, KEYS4, YL, path_sql, supplier_years, yearly_stats
from wayline.sources.bindings import FEATURES, ITEMS_SQL, MESSAGES_SQL, YEARS_SQL, message_texts, supplier_year_means, with_supplier_domain

AK = ["domain", "field", "author_id"]
STATS3 = ["cv", "rmssd_norm", "masd_norm"]
SPACE_COLS = {"ce": FEATURES, "tfidf": ["quantity", "price"], "sbert": ["discount", "tax"]}


def is_human():
    """Return flag N is the reference side, A and R are the models."""
    return F.col("model") == "N"


def unified(spark, sf):
    """Variability and three path geometries per author key, one row each (D3): one scan, one window, one aggregate."""
    wide = profile.wide_profile(supplier_year_means(spark, sf), ["field", "author_id", "model"], ["year"], FEATURES, SPACE_COLS, STATS3)
    return with_supplier_domain(spark, sf, wide).select(*KEYS4, *UNI_COLS)


def space_geometry(spark, sf):
    """Path metrics of every feature space in one pass."""
    pts = geometry.space_vectors(supplier_years(spark, sf), [*KEYS4, "year"], SPACE_COLS)
    return geometry.path_metrics(pts, [*KEYS4, "space"], ["year"])


def left_null_safe(left, right, keys):
    """Left join in which NULL keys match NULL keys."""
    payload = [c for c in right.columns if c not in keys]
    return left.join(right, null_safe_equal(left, right, keys), "left").select(left["*"], *[right[c] for c in payload])


UNI_COLS = [f"{f}_{s}" for f in FEATURES for s in STATS3] + [f"{s}_{m}" for s in SPACE_COLS for m in geometry.METRICS]


def unified_long(spark, sf):
    return unpivot(unified(spark, sf), KEYS4, UNI_COLS)


def comparisons(spark, sf):
    c = compare.matched_wide(unified(spark, sf), AK, UNI_COLS, is_human())
    return c.withColumn("feature_type", feat.feature_group(F.col("feature")))


def win_counts(spark, sf, *by):
    """Wins by feature and the columns in ``by``, a small table that every report of rates starts from."""
    wide = unified(spark, sf).withColumn("level", F.concat(F.lit("LV"), F.pmod("author_id", F.lit(3)) + 1))
    c = compare.win_counts(wide, AK, UNI_COLS, is_human(), list(by))
    return c.withColumn("feature_type", feat.feature_group(F.col("feature")))


UNI = YL.rstrip() + f""",
 pt AS (SELECT 'ce' AS space, {K4}, year AS t, [quantity, price, discount, tax] AS vec FROM f1
   UNION ALL SELECT 'tfidf', {K4}, year, [quantity, price] FROM f1 UNION ALL SELECT 'sbert', {K4}, year, [discount, tax] FROM f1),
 {path_sql('space, ' + K4)},
 ul AS (SELECT {K4}, feature || '_cv' AS feature, sqrt(variance) / nullif(abs(mean), 0) AS value FROM s
   UNION ALL SELECT {K4}, feature || '_rmssd_norm', rmssd / nullif(abs(mean), 0) FROM s
   UNION ALL SELECT {K4}, feature || '_masd_norm', masd / nullif(abs(mean), 0) FROM s""" + "".join(
    f"\n   UNION ALL SELECT {K4}, space || '_{m}', {m} FROM g" for m in geometry.METRICS) + """),
 cmp AS (SELECT h.domain, h.field, h.author_id, h.feature, l.model, h.value AS human_value, l.value AS llm_value, CAST(h.value > l.value AS INTEGER) AS human_wins,
   CASE WHEN regexp_matches(h.feature, '_(cv|rmssd_norm|masd_norm)$') THEN 'CE-VAR' WHEN h.feature LIKE 'ce\\_%' ESCAPE '\\' THEN 'CE-GEO'
     WHEN h.feature LIKE 'tfidf\\_%' ESCAPE '\\' THEN 'TF-IDF-GEO' ELSE 'SBERT-GEO' END AS feature_type
   FROM ul h JOIN ul l USING (domain, field, author_id, feature) WHERE h.model = 'N' AND l.model <> 'N' AND h.value IS NOT NULL AND l.value IS NOT NULL) """

# ----------------------------------------------------------------------- joins


def halves(spark, sf):
    """Two feature tables on the same keys, each missing some rows of the other."""
    y = supplier_years(spark, sf)
    keys = [*KEYS4, "year"]
    a = y.where(F.pmod("author_id", F.lit(5)) != 0).select(*keys, "quantity", "price")
    b = y.where(F.col("year") != 2000).select(*keys, "discount", "tax")
    return a, b, keys


@query("D1_merge_feature_tables", f"""WITH {YEARS_SQL}, a AS (SELECT {K4}, year, quantity, price FROM f1 WHERE author_id % 5 <> 0),
 b AS (SELECT {K4}, year, discount, tax FROM f1 WHERE year <> 2000)
 SELECT {K4}, year, round(quantity, 6) AS quantity, round(price, 6) AS price, round(discount, 8) AS discount, round(tax, 8) AS tax
 FROM a JOIN b USING ({K4}, year)""")
def d1(spark, sf):
    a, b, keys = halves(spark, sf)
    return rounded(rounded(a.join(b, keys), 6, "quantity", "price"), 8, "discount", "tax")


@query("D2_common_key_chain", f"""WITH {YEARS_SQL}, {{MASKED}}
 SELECT m.domain, m.field, m.author_id, m.model, m.year, round(m.price, 6) AS price, round(list_sum(list_transform(range(1, 3), lambda i: v.vec[i])), 6) AS v_sum,
   round(w.vec[1], 8) AS w_first
 FROM mk m JOIN (SELECT {K4}, year, [quantity, price] AS vec FROM f1 WHERE author_id % 5 <> 0) v USING ({K4}, year)
 JOIN (SELECT {K4}, year, [discount, tax] AS vec FROM f1 WHERE year <> 2000) w USING ({K4}, year)""".replace("{MASKED}", f"""
 q AS (SELECT model, domain, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f1 GROUP BY ALL),
 mk AS (SELECT f1.domain, field, author_id, f1.model, year, CASE WHEN f1.model <> 'N' AND (price < q1 - 1.500000001::DOUBLE * (q3 - q1) OR price > q3 + 1.500000001::DOUBLE * (q3 - q1)) THEN NULL ELSE price END AS price
   FROM f1 JOIN q ON f1.model = q.model AND f1.domain = q.domain)"""))
def d2(spark, sf):
    from wayline.operators import clean

    a, b, keys = halves(spark, sf)
    price = supplier_years(spark, sf).select(*keys, "price")
    masked = clean.mask_outliers(price.where(~is_human()), ["model", "domain"], "price").drop("is_outlier")
    base = price.where(is_human()).unionByName(masked)
    v = a.select(*keys, F.array("quantity", "price").alias("v"))
    w = b.select(*keys, F.array("discount", "tax").alias("w"))
    out = base.join(v, keys).join(w, keys).select(*keys, "price", (F.col("v")[0] + F.col("v")[1]).alias("v_sum"), F.col("w")[0].alias("w_first"))
    return rounded(rounded(out, 6, "price", "v_sum"), 8, "w_first")


@query("D3_unified_left_join", UNI + f"SELECT {K4}, " + ", ".join(
    f"round(max(CASE WHEN feature = '{c}' THEN value END), 6) + 0.0 AS {c}" for c in UNI_COLS
) + " FROM ul GROUP BY ALL")
def d3(spark, sf):
    return rounded(unified(spark, sf).select(*KEYS4, *UNI_COLS), 6)


@query("D3_null_keys_match", f"""WITH {YEARS_SQL}, a AS (SELECT CASE WHEN author_id % 4 = 0 THEN NULL ELSE domain END AS domain, field, author_id, year, avg(price) AS price FROM f1 WHERE year < 2001 GROUP BY ALL),
 b AS (SELECT CASE WHEN author_id % 4 = 0 THEN NULL ELSE domain END AS domain, field, author_id, year, avg(tax) AS tax FROM f1 WHERE year > 1996 GROUP BY ALL)
 SELECT a.domain, a.field, a.author_id, a.year, round(price, 5) AS price, round(tax, 8) AS tax FROM a LEFT JOIN b
  ON a.domain IS NOT DISTINCT FROM b.domain AND a.field = b.field AND a.author_id = b.author_id AND a.year = b.year""")
def d3n(spark, sf):
    y = supplier_years(spark, sf).withColumn("domain", F.when(F.pmod("author_id", F.lit(4)) != 0, F.col("domain")))
    keys = [*AK, "year"]
    a = y.where("year < 2001").groupBy(*keys).agg(F.avg("price").alias("price"))
    b = y.where("year > 1996").groupBy(*keys).agg(F.avg("tax").alias("tax"))
    return rounded(rounded(left_null_safe(a, b, keys), 5, "price"), 8, "tax")


@query("D4_matched_comparison", UNI + """SELECT domain, field, author_id, feature, feature_type, model, round(human_value, 6) + 0.0 AS human_value,
 round(llm_value, 6) + 0.0 AS llm_value, human_wins FROM cmp""")
def d4(spark, sf):
    return rounded(comparisons(spark, sf), 6)


LOOSE = f"""lo AS (SELECT domain, CASE WHEN author_id % 10 = 0 AND model = 'N' THEN NULL ELSE field END AS field,
   CASE WHEN author_id % 10 = 0 AND model = 'N' THEN NULL ELSE author_id END AS author_id, model, year, feature, value FROM f1l),
 ha AS (SELECT * FROM lo WHERE model = 'N'), ma AS (SELECT * FROM lo WHERE model <> 'N'),
 kd AS (SELECT h.domain, h.field, h.author_id, h.year, h.feature, m.model, h.value AS human_value, m.value AS llm_value, CAST(1 AS BIGINT) AS n_matched
   FROM ha h JOIN ma m ON h.domain = m.domain AND h.field = m.field AND h.author_id = m.author_id AND h.year = m.year AND h.feature = m.feature),
 ld AS (SELECT h.domain, h.field, h.author_id, h.year, h.feature, d.model, h.value, d.v, d.n FROM ha h JOIN
   (SELECT domain, feature, model, avg(value) AS v, count(*) AS n FROM ma GROUP BY ALL) d ON h.domain = d.domain AND h.feature = d.feature WHERE h.author_id IS NULL)"""


@query("D5_matched_difference_with_fallback", YL.rstrip() + f""", {LOOSE}
 SELECT domain, field, author_id, year, feature, model, round(human_value, 4) AS human_value, n_matched,
   round(human_value - llm_value, 2) + 0.0 AS difference FROM (SELECT * FROM kd UNION ALL SELECT * FROM ld)""".replace("round(human_value, 4)", "round(human_value, 6)").replace(", 2) + 0.0", ", 6) + 0.0"))
def d5(spark, sf):
    loose = (F.pmod("author_id", F.lit(10)) == 0) & is_human()
    long = unpivot(supplier_years(spark, sf), [*KEYS4, "year"], FEATURES).withColumns({
        "field": F.when(~loose, F.col("field")), "author_id": F.when(~loose, F.col("author_id"))})
    out = compare.matched_differences(long, ["field", "author_id", "year"], "domain", is_human())
    return rounded(out.drop("llm_value"), 6)


def message_lengths(spark, sf):
    """Word counts of the messages on both sides."""
    from wayline.functions.text import whitespace_words

    return message_texts(spark, sf).select("author_id", "item", "label", whitespace_words(F.col("text")).alias("value"))


WORDS_SQL = MESSAGES_SQL + """, wl AS (SELECT author_id, item, label, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS value FROM msgs)"""


@query("D6_pairwise_difference_summary", f"""WITH {WORDS_SQL}, p AS (SELECT CAST(h.value - l.value AS DOUBLE) AS d FROM wl h, wl l WHERE h.label = 'human' AND l.label = 'llm')
 SELECT count(*) AS n_pairs, round(avg(d), 6) AS mean_difference, round(var_pop(d), 4) AS variance, CAST(min(d) AS INTEGER) AS min_difference, CAST(max(d) AS INTEGER) AS max_difference FROM p""")
def d6(spark, sf):
    df = compare.pair_difference_summary(message_lengths(spark, sf).withColumn("g", F.lit(1)), ["g"], F.col("label") == "human")
    return rounded(rounded(df.drop("g"), 6, "mean_difference"), 4, "variance")


@query("D6_pairwise_difference_histogram", f"""WITH {WORDS_SQL}, p AS (SELECT h.value - l.value AS d FROM wl h, wl l WHERE h.label = 'human' AND l.label = 'llm'),
 b AS (SELECT min(d) AS lo, CAST(ceil((max(d) - min(d) + 1) / 30.0) AS INTEGER) AS w FROM p), k AS (SELECT CAST(least((d - lo) // w, 29) AS INTEGER) AS bin FROM p, b),
 c AS (SELECT bin, count(*) AS n FROM k GROUP BY 1)
 SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(30) r(i) LEFT JOIN c ON c.bin = i""")
def d6h(spark, sf):
    df = message_lengths(spark, sf).withColumn("g", F.lit(1))
    human = F.col("label") == "human"
    span = compare.pair_difference_summary(df, ["g"], human).select(
        F.col("min_difference").alias("low"),
        F.ceil((F.col("max_difference") - F.col("min_difference") + 1) / 30).cast("int").alias("width"))
    return compare.pair_difference_histogram(df.join(F.broadcast(span)), ["g"], human, "value", "low", "width", 30).select("bin", "n")


@query("D7_one_column_per_model", f"""WITH {YEARS_SQL}, p AS (SELECT domain, field, author_id, year, max(CASE WHEN model = 'N' THEN price END) AS n,
  max(CASE WHEN model = 'A' THEN price END) AS a, max(CASE WHEN model = 'R' THEN price END) AS r FROM f1 WHERE NOT (author_id % 7 = 0 AND model = 'R') GROUP BY ALL)
 SELECT domain, field, author_id, year, round(n, 6) AS human, round(a, 6) AS model_a, round(r, 6) AS model_r FROM p WHERE n IS NOT NULL AND a IS NOT NULL AND r IS NOT NULL""")
def d7(spark, sf):
    return rounded(per_model(spark, sf).dropna(how="any", subset=["human", "model_a", "model_r"]), 6)


def per_model(spark, sf):
    y = supplier_years(spark, sf).where(~((F.pmod("author_id", F.lit(7)) == 0) & (F.col("model") == "R")))
    return y.groupBy(*AK, "year").pivot("model", ["N", "A", "R"]).agg(F.first("price")).select(
        *AK, "year", F.col("N").alias("human"), F.col("A").alias("model_a"), F.col("R").alias("model_r"))


MASKED_UL = "mu AS (SELECT * FROM ul WHERE NOT (author_id % 6 = 1 AND feature LIKE 'tax%') AND value IS NOT NULL)"


def holed_long(spark, sf):
    long = unified_long(spark, sf)
    return long.where(~((F.pmod("author_id", F.lit(6)) == 1) & F.col("feature").startswith("tax"))).where("value IS NOT NULL")


@query("D8_ids_complete_in_every_stat", UNI.rstrip() + f""", {MASKED_UL}, ok AS (SELECT {K4} FROM mu WHERE feature LIKE '%\\_norm' ESCAPE '\\' GROUP BY ALL HAVING count(DISTINCT feature) = 8)
 SELECT {K4}, feature, round(value, 6) AS value FROM mu JOIN ok USING ({K4}) WHERE feature LIKE '%\\_norm' ESCAPE '\\'""")
def d8(spark, sf):
    rows = holed_long(spark, sf).where(F.col("feature").endswith("_norm"))
    complete = rows.groupBy(*KEYS4).agg(F.count_distinct("feature").alias("k")).where("k = 8").drop("k")
    return rounded(rows.join(complete, KEYS4, "left_semi"), 6)


D9_STATS = {"cv": "sqrt(variance) / nullif(abs(mean), 0)", "rmssd_norm": "rmssd / nullif(abs(mean), 0)", "masd_norm": "masd / nullif(abs(mean), 0)"}


@query("D9_statistics_side_by_side", YL + f"SELECT {K4}, " + ", ".join(
    f"round(max(CASE WHEN feature = '{f}' THEN {e} END), 6) AS {f}_{n}" for n, e in D9_STATS.items() for f in FEATURES) + " FROM s GROUP BY ALL")
def d9(spark, sf):
    """One table per statistic, as they are kept, put side by side by the author's key."""
    st = yearly_stats(spark, sf)
    tables = [st.groupBy(*KEYS4).pivot("feature", FEATURES).agg(F.first(n)).withColumnsRenamed({f: f"{f}_{n}" for f in FEATURES}) for n in D9_STATS]
    return rounded(compare.side_by_side(tables, KEYS4), 6)


@query("D11_win_rate_by_domain_and_model", UNI + """SELECT domain, model, count(*) AS n_comparisons, CAST(sum(human_wins) AS BIGINT) AS human_wins, round(avg(human_wins), 8) AS human_win_rate FROM cmp GROUP BY ALL""")
def d11(spark, sf):
    return rounded(compare.win_summary(win_counts(spark, sf, "domain", "model"), ["domain", "model"], True), 8)


@query("D15_difference_from_baseline", f"WITH {ITEMS_SQL}, m AS (SELECT domain, model, " + ", ".join(f"avg({f}) AS {f}" for f in FEATURES) + " FROM items GROUP BY ALL) SELECT a.domain, a.model, " + ", ".join(
    f"round(a.{f} - b.{f}, 6) + 0.0 AS {f}" for f in FEATURES) + " FROM m a JOIN m b USING (domain) WHERE a.model <> 'N' AND b.model = 'N'")
def d15(spark, sf):
    from wayline.sources.bindings import supplier_items, with_supplier_domain

    part = supplier_items(spark, sf).groupBy("author_id", "model").agg(F.count(F.lit(1)).alias("c"), *[F.sum(f).alias(f) for f in FEATURES])
    m = with_supplier_domain(spark, sf, part).groupBy("domain", "model").agg(*[(F.sum(f) / F.sum("c")).alias(f) for f in FEATURES])
    return rounded(compare.baseline_difference(m, "domain", is_human(), FEATURES), 6)


# ------------------------------------------------------------------ aggregates


@query("E12_side_statistics", UNI + """SELECT feature, round(avg(value) FILTER (model = 'N'), 3) + 0.0 AS human_mean, round(stddev_samp(value) FILTER (model = 'N'), 3) AS human_std,
 round(avg(value) FILTER (model <> 'N'), 3) + 0.0 AS llm_mean, round(stddev_samp(value) FILTER (model <> 'N'), 3) AS llm_std,
 round(CASE WHEN avg(value) FILTER (model <> 'N') > 0 THEN avg(value) FILTER (model = 'N') / avg(value) FILTER (model <> 'N') END, 6) AS ratio
 FROM ul WHERE value IS NOT NULL GROUP BY feature""")
def e12(spark, sf):
    df = compare.side_statistics(unified_long(spark, sf), ["feature"], is_human())
    return rounded(rounded(df, 3, "human_mean", "human_std", "llm_mean", "llm_std"), 6, "ratio")


@query("E12_median_and_percent_difference", UNI + """, dd AS (SELECT feature, avg(value) FILTER (model = 'N') AS hm, avg(value) FILTER (model <> 'N') AS lm,
  median(value) FILTER (model = 'N') AS hd, median(value) FILTER (model <> 'N') AS ld, stddev_pop(value) FILTER (model = 'N') AS hs, stddev_pop(value) FILTER (model <> 'N') AS ls FROM ul WHERE value IS NOT NULL GROUP BY 1)
 SELECT feature, round(hd, 3) + 0.0 AS human_median, round(ld, 3) + 0.0 AS llm_median, round(hs / nullif(abs(hm), 0), 6) AS human_cv, round(ls / nullif(abs(lm), 0), 6) AS llm_cv,
  round((hm - lm) * 100.0 / nullif(abs(lm), 0), 5) AS pct_diff FROM dd""")
def e12m(spark, sf):
    df = compare.descriptive_comparison(unified_long(spark, sf), ["feature"], is_human())
    df = df.select("feature", "human_median", "llm_median", "human_cv", "llm_cv", "pct_diff")
    return rounded(rounded(rounded(df, 3, "human_median", "llm_median"), 6, "human_cv", "llm_cv"), 5, "pct_diff")


@query("E13_skewness_kurtosis", UNI + """, z AS (SELECT feature, CASE WHEN model = 'N' THEN 'human' ELSE 'llm' END AS side, value FROM ul WHERE value IS NOT NULL),
 m AS (SELECT *, avg(value) OVER (PARTITION BY feature, side) AS mu FROM z),
 c AS (SELECT feature, side, avg((value - mu) ** 3) / avg((value - mu) ** 2) ** 1.5 AS sk, avg((value - mu) ** 4) / avg((value - mu) ** 2) ** 2 - 3 AS ku FROM m GROUP BY ALL)
 SELECT feature, round(max(CASE WHEN side = 'human' THEN sk END), 5) AS human_skewness, round(max(CASE WHEN side = 'llm' THEN sk END), 5) AS llm_skewness,
  round(max(CASE WHEN side = 'human' THEN ku END), 5) AS human_kurtosis, round(max(CASE WHEN side = 'llm' THEN ku END), 5) AS llm_kurtosis FROM c GROUP BY 1""")
def e13(spark, sf):
    df = compare.descriptive_comparison(unified_long(spark, sf), ["feature"], is_human())
    return rounded(df.select("feature", "human_skewness", "llm_skewness", "human_kurtosis", "llm_kurtosis"), 5)


RATIO_SQL = """r AS (SELECT feature, CASE WHEN avg(value) FILTER (model <> 'N') > 0 THEN avg(value) FILTER (model = 'N') / avg(value) FILTER (model <> 'N') END AS ratio,
  avg(value) FILTER (model = 'N') AS hm, avg(value) FILTER (model <> 'N') AS lm FROM ul WHERE value IS NOT NULL GROUP BY 1)"""
FAMILY = """CASE WHEN regexp_matches(feature, '_(cv|rmssd_norm|masd_norm)$') THEN 'variability' WHEN feature LIKE '%path_length' THEN 'path_length'
  WHEN feature LIKE '%net_displacement' THEN 'net_displacement' WHEN feature LIKE '%tortuosity' THEN 'tortuosity' WHEN feature LIKE '%direction_consistency' THEN 'direction_consistency' ELSE 'other' END"""


def family(feature):
    return (
        F.when(feature.rlike("_(cv|rmssd_norm|masd_norm)$"), "variability").when(feature.endswith("path_length"), "path_length")
        .when(feature.endswith("net_displacement"), "net_displacement").when(feature.endswith("tortuosity"), "tortuosity")
        .when(feature.endswith("direction_consistency"), "direction_consistency").otherwise("other")
    )


@query("E14_average_ratio", UNI + f""", {RATIO_SQL} SELECT {FAMILY} AS family, round(avg(CASE WHEN ratio < 100 THEN ratio END), 6) AS avg_ratio, count(ratio) AS n FROM r GROUP BY 1""")
def e14(spark, sf):
    df = compare.side_statistics(unified_long(spark, sf), ["feature"], is_human())
    return rounded(df.groupBy(family(F.col("feature")).alias("family")).agg(
        F.avg(F.when(F.col("ratio") < 100, F.col("ratio"))).alias("avg_ratio"), F.count("ratio").alias("n")), 6)


def hypothesis_verdicts(stats):
    """Verdict per hypothesis from the per-feature side statistics; thresholds are fixed values."""
    f = stats.withColumn("family", family(F.col("feature"))).where("family <> 'other'").groupBy("family").agg(
        F.avg(F.when(F.col("ratio") < 100, F.col("ratio"))).alias("avg_ratio"), F.avg("human_mean").alias("hm"), F.avg("llm_mean").alias("lm"))
    fam, r = F.col("family"), F.col("avg_ratio")
    confirmed = (
        F.when(fam == "variability", r > 2.0).when(fam.isin("path_length", "net_displacement"), r > 1.5)
        .when(fam == "tortuosity", (F.col("hm") > 1.5) & (F.abs(F.col("lm") - 1.0) < 0.3)).otherwise(F.col("hm") < F.col("lm"))
    )
    return f.select("family", "avg_ratio", F.when(confirmed, "CONFIRMED").otherwise("PARTIAL").alias("verdict"))


@query("E15_hypothesis_verdicts", UNI + f""", {RATIO_SQL}, f AS (SELECT {FAMILY} AS family, avg(CASE WHEN ratio < 100 THEN ratio END) AS avg_ratio, avg(hm) AS hm, avg(lm) AS lm FROM r GROUP BY 1)
 SELECT family, round(avg_ratio, 6) AS avg_ratio, CASE WHEN CASE family WHEN 'variability' THEN avg_ratio > 2.0 WHEN 'path_length' THEN avg_ratio > 1.5 WHEN 'net_displacement' THEN avg_ratio > 1.5
   WHEN 'tortuosity' THEN hm > 1.5 AND abs(lm - 1.0) < 0.3 ELSE hm < lm END THEN 'CONFIRMED' ELSE 'PARTIAL' END AS verdict FROM f WHERE family <> 'other'""")
def e15(spark, sf):
    return rounded(hypothesis_verdicts(compare.side_statistics(unified_long(spark, sf), ["feature"], is_human())), 6)


@query("E17_wins_per_group", UNI + """SELECT feature, count(*) AS n_comparisons, CAST(sum(human_wins) AS BIGINT) AS human_wins, round(avg(human_wins), 8) AS human_win_rate FROM cmp GROUP BY 1""")
def e17(spark, sf):
    return rounded(compare.win_summary(win_counts(spark, sf), ["feature"], True), 8)


OVER = """SELECT coalesce(feature_type, 'OVERALL') AS feature_type, count(*) AS n_comparisons, CAST(sum(human_wins) AS BIGINT) AS human_wins, round(avg(human_wins), 8) AS human_win_rate FROM cmp GROUP BY ROLLUP (feature_type)"""


@query("E18_groups_and_overall", UNI + OVER)
def e18(spark, sf):
    return rounded(compare.win_summary_with_overall(win_counts(spark, sf), "feature_type", True), 8)


@query("E19_distinct_counts", UNI + """SELECT count(DISTINCT author_id) AS authors, count(DISTINCT feature) AS features, count(DISTINCT model) AS models,
 (SELECT count(*) FROM (SELECT DISTINCT domain, field, author_id FROM cmp)) AS keys FROM cmp""")
def e19(spark, sf):
    return comparisons(spark, sf).agg(
        F.count_distinct("author_id").alias("authors"), F.count_distinct("feature").alias("features"),
        F.count_distinct("model").alias("models"), F.count_distinct("domain", "field", "author_id").alias("keys"))


# ----------------------------------------------------------------------- tests

TAIL = """list_sum(list_transform(range({a}, {b} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))"""
GE, LE = TAIL.format(a="k", b="n"), TAIL.format(a="0", b="k")
BINOM = UNI.rstrip() + """, w AS (SELECT {g} AS grp, grouping({g}) AS gid, count(*) AS n, CAST(sum(human_wins) AS BIGINT) AS k FROM cmp2 GROUP BY ROLLUP ({g})),
 t AS (SELECT CASE WHEN gid = 1 THEN 'OVERALL' ELSE grp END AS grp, n, k, least(1.0, """ + GE + """) AS ge, least(1.0, """ + LE + """) AS le FROM w)"""


def _binom_oracle(g, cmp2, two_sided):
    alt = f"CASE WHEN grp IN ({two_sided}) THEN least(1.0, 2 * least(ge, le)) ELSE ge END"
    body = UNI.rstrip() + f", cmp2 AS ({cmp2})" + BINOM[len(UNI.rstrip()):].replace("{g}", g)
    return body + f""", p AS (SELECT *, {alt} AS p FROM t)
 SELECT grp AS {g}, n AS n_comparisons, k AS human_wins, round(k / n, 8) AS human_win_rate, CASE WHEN grp IN ({two_sided}) THEN 'two-sided' ELSE 'greater' END AS test_direction,
  round(p, 8) AS pvalue, CASE WHEN grp IN ({two_sided}) THEN CASE WHEN 2 * k > n THEN CASE WHEN ge < 0.05 THEN 'Human > LLM' ELSE 'not significant' END
    WHEN 2 * k < n THEN CASE WHEN le < 0.05 THEN 'LLM > Human' ELSE 'not significant' END ELSE 'equal' END END AS direction_note,
  p < 0.05 AS significant, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS significant_star FROM p"""


@query("I1_binomial_per_metric", _binom_oracle("metric", "SELECT *, regexp_extract(feature, '(cv|rmssd_norm|masd_norm)$', 1) AS metric FROM cmp WHERE feature_type = 'CE-VAR'", "'none'"))
def i1(spark, sf):
    c = win_counts(spark, sf).where("feature_type = 'CE-VAR'").withColumn("metric", feat.stat_suffix(F.col("feature")))
    return rounded(compare.binomial_table(c, "metric", counted=True), 8)


@query("I2_binomial_per_feature_group", _binom_oracle("feature_type", "SELECT * FROM cmp", "'TF-IDF-GEO'"))
def i2(spark, sf):
    return rounded(compare.binomial_table(win_counts(spark, sf), "feature_type", compare.ALTERNATIVES, counted=True), 8)


@query("I3_binomial_two_sided_overall", _binom_oracle("model", "SELECT * FROM cmp WHERE feature_type <> 'CE-VAR'", "'OVERALL'"))
def i3(spark, sf):
    c = win_counts(spark, sf, "model").where("feature_type <> 'CE-VAR'")
    return rounded(compare.binomial_table(c, "model", overall="two-sided", counted=True), 8)


@query("I4_binomial_per_feature", UNI.rstrip() + f""", t AS (SELECT feature, feature_type, count(*) AS n, CAST(sum(human_wins) AS BIGINT) AS k FROM cmp GROUP BY ALL)
 SELECT feature, feature_type, n AS n_comparisons, k AS human_wins, round(k / n, 8) AS human_win_rate, round(least(1.0, {GE}), 8) AS pvalue FROM t""")
def i4(spark, sf):
    t = per_feature_tests(spark, sf)
    return rounded(t, 8)


def per_feature_tests(spark, sf):
    from wayline.functions.pvalues import binomial_p

    t = compare.win_summary(win_counts(spark, sf), ["feature", "feature_type"], True)
    return t.withColumn("pvalue", binomial_p(F.col("human_wins"), F.col("n_comparisons")))


@query("G5_report_order", UNI + """, r AS (""" + OVER + """) SELECT row_number() OVER (ORDER BY CASE feature_type WHEN 'CE-VAR' THEN 1 WHEN 'CE-GEO' THEN 2
 WHEN 'TF-IDF-GEO' THEN 3 WHEN 'SBERT-GEO' THEN 4 WHEN 'OVERALL' THEN 5 ELSE 6 END) AS position, feature_type, n_comparisons FROM r""")
def g5(spark, sf):
    t = compare.win_summary_with_overall(win_counts(spark, sf), "feature_type", True)
    return t.select(feat.group_rank(F.col("feature_type")).cast("bigint").alias("position"), "feature_type", "n_comparisons").orderBy("position")


@query("G2_top_features_by_win_rate", UNI + """SELECT feature, round(avg(human_wins), 8) AS human_win_rate FROM cmp GROUP BY 1 ORDER BY human_win_rate DESC, feature LIMIT 10""")
def g2(spark, sf):
    t = rounded(compare.win_summary(win_counts(spark, sf), ["feature"], True), 8).select("feature", "human_win_rate")
    return t.orderBy(F.desc("human_win_rate"), "feature").limit(10)


VOTES = f"""WITH {YEARS_SQL}, p AS (SELECT domain, field, author_id, year, max(CASE WHEN model = 'N' THEN price END) AS h,
  max(CASE WHEN model = 'A' THEN price END) AS a, max(CASE WHEN model = 'R' THEN price END) AS r FROM f1 WHERE NOT (author_id % 7 = 0 AND model = 'R') GROUP BY ALL),
 v AS (SELECT *, CAST(h > (a + r) / 2 AS INTEGER) AS average, CAST((CAST(h > a AS INTEGER) + CAST(h > r AS INTEGER)) * 2 > 2 AS INTEGER) AS majority,
  CAST(h > a AND h > r AS INTEGER) AS all_models, CAST(h > a OR h > r AS INTEGER) AS any_model, CAST(h > greatest(a, r) AS INTEGER) AS maximum, CAST(h > least(a, r) AS INTEGER) AS minimum
  FROM p WHERE h IS NOT NULL AND a IS NOT NULL AND r IS NOT NULL)"""


@query("I17_label_definitions", VOTES + " UNION ALL ".join(
    f" SELECT '{d}' AS definition, round(avg({d}), 8) AS positive_share, round(avg(CAST({d} = average AS INTEGER)), 8) AS agreement, count(*) FILTER ({d} <> average) AS n_disagree, count(*) AS n FROM v"
    for d in compare.LABELS))
def i17(spark, sf):
    votes = compare.label_votes(per_model(spark, sf), "human", ["model_a", "model_r"])
    return rounded(compare.label_summary(votes), 8)


@query("I17_disagreements", VOTES + " SELECT domain, field, author_id, year, average, majority FROM v WHERE average <> majority")
def i17d(spark, sf):
    votes = compare.label_votes(per_model(spark, sf), "human", ["model_a", "model_r"])
    return votes.where("average <> majority").select(*AK, "year", "average", "majority")


