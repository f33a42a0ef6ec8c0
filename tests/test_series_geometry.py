import math

import pytest
from pyspark.sql import functions as F

from wayline.operators import clean, geometry, ordered, series


def series_df(spark, values, block=3):
    rows = [("a", t, None if v is None else float(v), t // block) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t int, value double, b int")


def by_hand(values):
    v = [x for x in values if x is not None]
    n = len(v)
    d = [b - a for a, b in zip(v, v[1:])]
    mean = sum(v) / n if n else None
    var = sum((x - mean) ** 2 for x in v) / (n - 1) if n > 1 else None
    return {
        "variance": var, "cv": math.sqrt(var) / abs(mean) if n > 1 and mean else None,
        "rmssd": math.sqrt(sum(x * x for x in d) / len(d)) if d else None, "masd": sum(map(abs, d)) / len(d) if d else None,
    }


@pytest.mark.parametrize("values", [[1], [2, 2, 2], [1, 3, 2], [1, None, 3], [-1, 1], [None, None], [5, 1, None, None, None, None, 7, 2, 9, 4], list(range(20))])
@pytest.mark.parametrize("block", [None, "b"])
def test_variability_matches_hand_values(spark, values, block):
    row = series.variability(series_df(spark, values), ["k"], ["t"], block=block).first()
    want = by_hand(values)
    assert row["sample_count"] == len(values)
    for k, v in want.items():
        assert row[k] == pytest.approx(v) if v is not None else row[k] is None, k


def test_macro_mode_has_zeros_and_signed_mean(spark):
    one = series.variability(series_df(spark, [4]), ["k"], ["t"], mode="macro").first()
    assert (one["cv"], one["rmssd_norm"], one["masd_norm"]) == (0.0, 0.0, 0.0)
    neg = series.variability(series_df(spark, [-1, -3]), ["k"], ["t"], mode="macro").first()
    assert neg["cv"] == pytest.approx(-0.5)


def test_differences_bridge_gaps_across_blocks(spark):
    df = series_df(spark, [1, None, None, None, 4, 6], block=2)
    got = {r["t"]: r["diff"] for r in series.successive_differences(df, ["k"], ["t"], block="b").collect()}
    assert got[0] is None and got[4] == 3.0 and got[5] == 2.0


def test_null_keys_form_one_series(spark):
    df = spark.createDataFrame([(None, 0, 1.0, 0), (None, 1, 3.0, 1)], "k string, t int, value double, b int")
    got = {r["t"]: r["diff"] for r in series.successive_differences(df, ["k"], ["t"], block="b").collect()}
    assert got[1] == 2.0


def test_position_puts_null_block_last(spark):
    df = spark.createDataFrame([("a", None, 9), ("a", 2001, 5), ("a", 2000, 7), ("a", 2000, 3)], "k string, y int, item int")
    got = {r["item"]: r["position"] for r in series.position(df, ["k"], ["y", "item"], "y").collect()}
    assert got == {3: 1, 7: 2, 5: 3, 9: 4}


def path_df(spark, points):
    return spark.createDataFrame([("a", t, [float(x) for x in p], t // 2) for t, p in enumerate(points)], "k string, t int, vec array<double>, b int")


def test_path_hand_cases(spark):
    m = lambda pts, **kw: geometry.path_metrics(path_df(spark, pts), ["k"], ["t"], **kw).first()
    back = m([(0, 0), (3, 4), (0, 0)])
    assert back["path_length"] == 10 and back["net_displacement"] == 0 and back["tortuosity"] == 1.0
    assert back["direction_consistency"] == pytest.approx(-1.0)
    assert m([(0, 0), (3, 4), (0, 0)], zero_net=None)["tortuosity"] is None
    line = m([(0, 0), (1, 1), (3, 3)])
    assert line["tortuosity"] == pytest.approx(1.0) and line["direction_consistency"] == pytest.approx(1.0)
    corner = m([(0, 0), (1, 0), (1, 1)])
    assert corner["direction_consistency"] == pytest.approx(0.0)
    assert m([(0, 0), (1, 0)])["direction_consistency"] is None
    single = m([(1, 2)])
    assert single["n_years"] == 1 and single["path_length"] is None and single["tortuosity"] is None


def test_rounding_noise_is_no_step(spark):
    r = geometry.path_metrics(path_df(spark, [(0.1 + 0.2, 1), (0.3, 1), (0.5, 1), (0.7, 1)]), ["k"], ["t"]).first()
    assert r["direction_consistency"] == pytest.approx(1.0)
    back = geometry.path_metrics(path_df(spark, [(0.1 + 0.2, 1), (1, 1), (0.3, 1)]), ["k"], ["t"]).first()
    assert back["net_displacement"] == 0 and back["tortuosity"] == 1.0


def test_document_path_equals_unblocked_path(spark):
    pts = [(math.sin(i), math.cos(2 * i), i % 5) for i in range(23)]
    df = path_df(spark, pts)
    a = geometry.document_path(df, ["k"], ["t"], "b").first()
    b = geometry.path_metrics(df, ["k"], ["t"], zero_net=None).first()
    for x, y in (("mean_yearly_distance", "mean_distance"), ("std_yearly_distance", "std_distance"), ("path_length", "path_length"),
                 ("net_displacement", "net_displacement"), ("tortuosity", "tortuosity")):
        assert a[x] == pytest.approx(b[y])
    assert geometry.document_path(path_df(spark, pts[:1]), ["k"], ["t"], "b").count() == 0


def test_yearly_vectors_skip_null_elements(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("a", [3.0, 4.0]), ("a", None)], "k string, vec array<double>")
    row = geometry.yearly_vectors(df, ["k"]).first()
    assert row["vec"] == [2.0, 4.0] and row["n_items"] == 2


def test_pair_spread_equals_pairs(spark):
    df = path_df(spark, [(0, 0), (3, 4), (6, 0), (1, 1)])
    got = geometry.pair_spread(df, ["k"]).first()
    a, b = df.select(F.col("t").alias("t1"), F.col("vec").alias("v1")), df.select(F.col("t").alias("t2"), F.col("vec").alias("v2"))
    from wayline.functions.vectors import l2

    want = a.join(b, F.col("t1") < F.col("t2")).select(F.avg(F.pow(l2(F.col("v1"), F.col("v2")), 2)), F.count("*")).first()
    assert got["mean_sq_distance"] == pytest.approx(want[0]) and got["n_pairs"] == want[1]


def test_masking_keeps_rows_and_ignores_zero_iqr(spark):
    rows = [("m", "d", float(v)) for v in (1, 2, 3, 4, 100)] + [("z", "d", v) for v in (5.0, 5.0, 5.0, 5.0, 9.0)] + [(None, None, 1.0)]
    df = clean.group_defaults(spark.createDataFrame(rows, "model string, domain string, value double"))
    m = clean.mask_outliers(df, ["model", "domain"])
    assert m.count() == len(rows)
    bad = m.where("is_outlier").collect()
    assert [r["model"] for r in bad] == ["m"] and bad[0]["value"] is None
    assert {r["model"]: r["outliers"] for r in clean.outlier_report(m, ["model"]).collect()} == {"m": 1, "z": 0, "ALL": 0}


def test_value_on_the_limit_is_inside(spark):
    noise = 0.1 + 0.2 - 0.3
    rows = [(v,) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 2.0 - 1.5 * 2.0 - noise, 8.0 + noise)]
    df = spark.createDataFrame(rows, "value double").withColumn("g", F.lit(1))
    b = clean.iqr_bounds(df, ["g"]).first()
    edge = df.unionByName(spark.createDataFrame([(1, b["q1"] - 1.5 * (b["q3"] - b["q1"]) - noise)], "g int, value double"))
    assert clean.iqr_bounds(df, ["g"]).first()["lower"] < edge.orderBy("value").first()["value"]


def test_groups_that_span_stretches_are_exact(spark):
    """Groups are spread over all partitions of the range exchange; results must equal numpy's."""
    import numpy as np

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 501 / 10.0).alias("v"))
    values = {}
    for r in df.collect():
        values.setdefault(r["g"], []).append(r["v"])
    probs = {"q1": 0.25, "q2": 0.5, "q9": 0.93}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["g"]: r for r in ordered.quantiles(df, ["g"], "v", probs).collect()}
        below = {(r["g"], r["v"]): r["n_below"] for r in ordered.cumulative(df, ["g"], "v", {"n": F.lit(1)}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, own in values.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(own, p)), (g, p)
        for v in set(own):
            assert below[g, v] == sum(x < v for x in own)


def test_null_times_come_last(spark):
    """Blocks and plain windows agree on items without a time or block."""
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 12.0), ("a", 3, 20.0), ("a", None, 50.0)], "k string, t int, value double")
    for block in (None, "t"):
        got = series.variability(df, ["k"], ["t"], block=block).first()
        assert got["rmssd"] == pytest.approx(((4 + 64 + 900) / 3) ** 0.5)
        diffs = {r["t"]: r["diff"] for r in series.successive_differences(df, ["k"], ["t"], block=block).collect()}
        assert diffs == {1: None, 2: 2.0, 3: 8.0, None: 30.0}
    points = df.withColumn("vec", F.array("value"))
    assert geometry.path_metrics(points, ["k"], ["t"]).first()["net_displacement"] == pytest.approx(40)
    assert geometry.document_path(points, ["k"], ["t"], "t").first()["net_displacement"] == pytest.approx(40)


def test_global_rank_is_a_permutation(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    for g in (0, 1):
        got = ordered.global_rank(df, ["g"], "h").where(F.col("g") == g).orderBy("h").select("_rank").collect()
        assert [r[0] for r in got] == list(range(250))
