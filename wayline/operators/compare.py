"""Matched and grouped comparison of a reference side with model sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.columns import safe_div
from wayline.functions.pvalues import binomial_p, stars
from wayline.operators.geometry import REST
from wayline.operators.ordered import cumulative, quantiles

ALTERNATIVES = {"TF-IDF-GEO": "two-sided"}


def wins(h: str, m: str) -> Column:
    """Whether h is larger than m; differences below rounding noise are ties, so the order of summation does not matter."""
    return F.expr(f"{h} > {m} AND {h} - {m} > {REST} * greatest(abs({h}), abs({m}))")


def matched_comparison(long: DataFrame, keys: list[str], reference: Column, model: str = "model",
                       feature: str = "feature", value: str = "value") -> DataFrame:
    """One row per (keys, feature, model) with both values; NULL keys or values never match.

    Both sides sit in one table, so the reference value is carried over inside
    its key: one shuffle instead of the two of a self-join. A key holds one
    reference row and one row per model.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = long.where(known & F.col(value).isNotNull())
    ref = F.max(F.when(reference, F.col(value))).over(Window.partitionBy(*keys, feature))
    both = rows.withColumn("human_value", ref).where(~reference & F.col("human_value").isNotNull())
    return both.select(*keys, feature, model, "human_value", F.col(value).alias("llm_value")).withColumn(
        "human_wins", wins("human_value", "llm_value").cast("int"))


def with_reference(wide: DataFrame, keys: list[str], features: list[str], reference: Column, model: str = "model") -> DataFrame:
    """Every model's wide row with ``_h``, its key's reference values: one row per key and model carries all features.

    NULL keys never match. A key holds one reference row.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    h = F.max(F.when(reference, F.struct(*features))).over(Window.partitionBy(*keys))
    return wide.where(known).withColumn("_h", h).where(~reference & F.col("_h").isNotNull())


def matched_wide(wide: DataFrame, keys: list[str], features: list[str], reference: Column, model: str = "model") -> DataFrame:
    """``matched_comparison`` of wide rows: the values meet before they are turned long."""
    both = with_reference(wide, keys, features, reference, model)
    pairs = ", ".join(f"struct('{f}' AS feature, _h.{f} AS human_value, {f} AS llm_value)" for f in features)
    long = both.selectExpr(*keys, model, f"inline(array({pairs}))").where("human_value IS NOT NULL AND llm_value IS NOT NULL")
    return long.select(*keys, "feature", model, "human_value", "llm_value", wins("human_value", "llm_value").cast("int").alias("human_wins"))


def win_counts(wide: DataFrame, keys: list[str], features: list[str], reference: Column, by: list[str], model: str = "model") -> DataFrame:
    """(by, feature, n, human_wins): wins counted on wide rows, so only a few numbers per group are ever long."""
    both = with_reference(wide, keys, features, reference, model)
    counts = [x for f in features for x in (F.expr(f"count(_h.{f} + {f}) AS _n_{f}"), F.count_if(wins(f"_h.{f}", f)).alias(f"_w_{f}"))]
    rows = ", ".join(f"struct('{f}' AS feature, _n_{f} AS n, _w_{f} AS human_wins)" for f in features)
    return both.groupBy(*by).agg(*counts).selectExpr(*by, f"inline(array({rows}))").where("n > 0")


def matched_differences(long: DataFrame, keys: list[str], domain: str, reference: Column, model: str = "model") -> DataFrame:
    """human - model per matched key and model.

    Rows whose key is incomplete fall back to their domain: they are compared
    with the mean of each model's values there (``n_matched`` of them), which
    keeps the result one row per model instead of one per pair.
    """
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    rows = long.where(F.col("value").isNotNull())
    h = rows.where(reference).withColumnRenamed("value", "human_value").drop(model)
    m = rows.where(~reference)
    keyed = h.where(full).join(
        m.where(full).select(domain, *keys, "feature", F.col(model), F.col("value").alias("llm_value")), [domain, *keys, "feature"]
    ).withColumn("n_matched", F.lit(1).cast("bigint"))
    by_domain = m.groupBy(domain, "feature", model).agg(F.avg("value").alias("llm_value"), F.count(F.lit(1)).alias("n_matched"))
    loose = h.where(~full).join(by_domain, [domain, "feature"])
    cols = [domain, *keys, "feature", model, "human_value", "llm_value", "n_matched"]
    return keyed.select(*cols).unionByName(loose.select(*cols)).withColumn("difference", F.col("human_value") - F.col("llm_value"))


def side_by_side(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Columns of tables with one row per key, joined on the keys that all of them hold; a column that an earlier table has stays out."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.select(*keys, *[c for c in t.columns if c not in out.columns]), keys)
    return out


def pair_difference_summary(df: DataFrame, groups: list[str], reference: Column, value: str = "value") -> DataFrame:
    """Mean, variance, minimum and maximum of all pairwise differences, in closed form."""
    h, m = F.when(reference, F.col(value)), F.when(~reference, F.col(value))
    return df.groupBy(*groups).agg(
        (F.count(h) * F.count(m)).alias("n_pairs"), (F.avg(h) - F.avg(m)).alias("mean_difference"),
        (F.var_pop(h) + F.var_pop(m)).alias("variance"),
        (F.min(h) - F.max(m)).alias("min_difference"), (F.max(h) - F.min(m)).alias("max_difference"),
    )


def pair_difference_histogram(df: DataFrame, groups: list[str], reference: Column, value: str, low: str, width: str,
                              bins: int) -> DataFrame:
    """Exact histogram of all pairwise differences without making a pair.

    ``low`` and ``width`` are columns, constant per group. For every edge the
    pairs below it are counted by ranking the shifted reference values among
    the model values, so the work is (rows x bins), not rows squared.
    """
    h = df.where(reference).groupBy(*groups, value, low, width).agg(F.count(F.lit(1)).alias("_w"))
    m = df.where(~reference).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_m"))
    shifted = h.select(*groups, "_w", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bins)), lambda j: F.col(value) - (F.col(low) + j * F.col(width)))).alias("_j", "_x"))
    events = shifted.select(*groups, "_x", "_j", "_w", F.lit(0).cast("bigint").alias("_m")).unionByName(
        m.select(*groups, F.col(value).cast("double").alias("_x"), F.lit(-1).alias("_j"), F.lit(0).cast("bigint").alias("_w"), "_m"))
    weights = {"_m": F.col("_m"), **{f"_e{j}": F.when(F.col("_j") == j, F.col("_w")).otherwise(0) for j in range(bins + 1)}}
    cum = cumulative(events, groups, "_x", weights)
    # pairs with difference >= edge j have a model value at or below the shifted value
    at_least = cum.groupBy(*groups).agg(*[
        F.sum(F.col(f"_e{j}") * (F.col("_m_below") + F.col("_m"))).alias(f"_g{j}") for j in range(bins + 1)])
    counts = [F.col(f"_g{j}") - F.col(f"_g{j + 1}") if j < bins - 1 else F.col(f"_g{j}") for j in range(bins)]
    return at_least.select(*groups, F.posexplode(F.array(*counts)).alias("bin", "n"))


def _wins(counted: bool) -> list[Column]:
    n = F.sum("n") if counted else F.count(F.lit(1))
    rate = F.sum("human_wins") / F.sum("n") if counted else F.avg("human_wins")
    return [n.alias("n_comparisons"), F.sum("human_wins").alias("human_wins"), rate.alias("human_win_rate")]


def win_summary(cmp: DataFrame, groups: list[str], counted: bool = False) -> DataFrame:
    """Comparisons, wins and rate per group; ``counted``: rows are those of ``win_counts``."""
    return cmp.groupBy(*groups).agg(*_wins(counted))


def win_summary_with_overall(cmp: DataFrame, group: str, counted: bool = False) -> DataFrame:
    """Groups plus an OVERALL row in one pass."""
    return cmp.rollup(group).agg(F.grouping_id().alias("_gid"), *_wins(counted)).withColumn(
        group, F.when(F.col("_gid") == 1, "OVERALL").otherwise(F.col(group))).drop("_gid")


def binomial_table(cmp: DataFrame, group: str, alternatives: dict[str, str] | None = None, overall: str = "greater",
                   alpha: float = 0.05, counted: bool = False) -> DataFrame:
    """Exact binomial test per group and OVERALL; ``alternatives`` overrides one-sided greater."""
    alts = {**(alternatives or {}), "OVERALL": overall}
    table = F.create_map(*[F.lit(x) for kv in alts.items() for x in kv])
    t = win_summary_with_overall(cmp, group, counted)
    t = t.withColumn("test_direction", F.coalesce(table[F.col(group)], F.lit("greater")))
    k, n = F.col("human_wins"), F.col("n_comparisons")
    t = t.withColumns({
        "pvalue": binomial_p(k, n, F.col("test_direction")),
        "_ge": binomial_p(k, n, "greater"), "_le": binomial_p(k, n, "less"),
    })
    rate = F.col("human_win_rate")
    note = (
        F.when(rate > 0.5, F.when(F.col("_ge") < alpha, "Human > LLM").otherwise("not significant"))
        .when(rate < 0.5, F.when(F.col("_le") < alpha, "LLM > Human").otherwise("not significant")).otherwise("equal")
    )
    return t.withColumns({
        "direction_note": F.when(F.col("test_direction") == "two-sided", note),
        "significant": F.col("pvalue") < alpha, "significant_star": stars(F.col("pvalue")),
    }).drop("_ge", "_le")


def side_statistics(long: DataFrame, groups: list[str], reference: Column, value: str = "value", ddof: int = 1) -> DataFrame:
    """Mean and deviation per side and the ratio of means (NULL where the model mean is not positive)."""
    h, m = F.when(reference, F.col(value)), F.when(~reference, F.col(value))
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    return long.groupBy(*groups).agg(
        F.avg(h).alias("human_mean"), sd(h).alias("human_std"), F.avg(m).alias("llm_mean"), sd(m).alias("llm_std"),
    ).where("human_mean IS NOT NULL AND llm_mean IS NOT NULL").withColumn(
        "ratio", F.when(F.col("llm_mean") > 0, F.col("human_mean") / F.col("llm_mean")))


def descriptive_comparison(long: DataFrame, groups: list[str], reference: Column, value: str = "value") -> DataFrame:
    """Mean, population sd, median, CV and shape per side, and the mean difference."""
    side = F.when(reference, F.lit("human")).otherwise("llm")
    rows = long.withColumn("_side", side)
    v = F.col(value)
    moments = rows.groupBy(*groups, "_side").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    med = quantiles(rows, [*groups, "_side"], value, {"median": 0.5})
    both = moments.join(med, [*groups, "_side"]).withColumn("cv", safe_div(F.col("std"), F.abs(F.col("mean"))))
    stats = ["n", "mean", "std", "median", "cv", "skewness", "kurtosis"]
    wide = both.groupBy(*groups).pivot("_side", ["human", "llm"]).agg(*[F.first(s).alias(s) for s in stats])
    diff = F.col("human_mean") - F.col("llm_mean")
    return wide.withColumns({"mean_diff": diff, "pct_diff": safe_div(diff * 100.0, F.abs(F.col("llm_mean")))})


def baseline_difference(df: DataFrame, group: str, reference: Column, features: list[str], model: str = "model") -> DataFrame:
    """Each model row minus the reference row of its group."""
    base = df.where(reference).select(group, *[F.col(f).alias(f"_b_{f}") for f in features])
    return df.where(~reference).join(base, group).select(
        group, model, *[(F.col(f) - F.col(f"_b_{f}")).alias(f) for f in features])


def label_votes(wide: DataFrame, human: str, models: list[str]) -> DataFrame:
    """Six ways to label 'human above the models' for rows where every value is known."""
    c = wide.dropna(how="any", subset=[human, *models])
    h = F.col(human)
    wins = sum((h > F.col(m)).cast("int") for m in models)
    k = len(models)
    mean = sum(F.col(m) for m in models) / F.lit(float(k))
    return c.withColumns({
        "average": (h > mean).cast("int"), "majority": (wins * 2 > k).cast("int"), "all_models": (wins == k).cast("int"),
        "any_model": (wins >= 1).cast("int"), "maximum": (h > F.greatest(*models)).cast("int"), "minimum": (h > F.least(*models)).cast("int"),
    })


LABELS = ["average", "majority", "all_models", "any_model", "maximum", "minimum"]


def label_summary(votes: DataFrame) -> DataFrame:
    """Share of positive labels per definition, and agreement with the average rule."""
    n = F.count(F.lit(1))
    cols = [F.struct(F.lit(d).alias("definition"), F.avg(d).alias("positive_share"),
                     F.avg((F.col(d) == F.col("average")).cast("int")).alias("agreement"),
                     F.count_if(F.col(d) != F.col("average")).alias("n_disagree"), n.alias("n")) for d in LABELS]
    return votes.agg(F.array(*cols).alias("_r")).select(F.inline("_r"))
