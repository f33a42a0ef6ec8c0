import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import pvalues
from wayline.operators import compare, evaluate, ranks, split, trend

# Golden yearly differences 2020..2024, slope of their absolute value, class.
GOLDEN_SLOPES = {
    "Openness": ([-0.018861117300330382, -0.019631536635715485, -0.016896870486050153, -0.017689704857751315, -0.019635063804103514], -3.939387704188085e-05, "converging"),
    "Agreeableness": ([0.03942853510098565, 0.04096304654446406, 0.04068135618776958, 0.042756403233848134, 0.04183113689313661], 0.0006598560273685306, "diverging"),
    "num_words": ([22.088679037111334, 23.27199999999999, 23.74464529058116, 24.433693693693684, 28.260875502008034], 1.3506086623484608, "diverging"),
    "flesch_reading_ease": ([32.84373791302865, 31.3981629297997, 32.26294871594369, 31.394052498672412, 30.846058633463656], -0.3999468990256774, "converging"),
}
# Golden yearly accuracies 2020..2024 with slope, r, p, stderr.
GOLDEN_TRENDS = {
    "academic": ([0.92, 0.936, 0.922, 0.9093333333333333, 0.8886666666666667], -0.008933333333333338, -0.802122024388721, 0.10247076311738124, 0.0038397530784809192),
    "blogs": ([0.8906666666666667, 0.8753333333333333, 0.8873333333333333, 0.9053333333333333, 0.8906666666666667], 0.0030000000000000027, 0.4432260819498388, 0.45473095864974244, 0.003503014574778578),
    "news": ([0.9693333333333334, 0.9713333333333334, 0.9706666666666667, 0.9646666666666667, 0.9566666666666667], -0.003200000000000014, -0.8295613557843415, 0.08227332307426488, 0.0012436505404118412),
}


def test_golden_convergence_slopes(spark):
    rows = [(f, 2020 + i, v) for f, (vals, _, _) in GOLDEN_SLOPES.items() for i, v in enumerate(vals)]
    got = {r["feature"]: r for r in trend.convergence(spark.createDataFrame(rows, "feature string, year int, difference double"), ["feature"]).collect()}
    for f, (_, slope, cls) in GOLDEN_SLOPES.items():
        assert got[f]["slope_abs"] == pytest.approx(slope, rel=1e-9) and got[f]["trend"] == cls


def test_golden_accuracy_trends(spark):
    rows = [(d, 2020 + i, v) for d, (vals, *_) in GOLDEN_TRENDS.items() for i, v in enumerate(vals)]
    got = {r["domain"]: r for r in trend.regress(spark.createDataFrame(rows, "domain string, year int, v double"), ["domain"], "year", F.col("v")).collect()}
    for d, (_, slope, r, p, se) in GOLDEN_TRENDS.items():
        assert got[d]["slope"] == pytest.approx(slope, rel=1e-9) and got[d]["correlation"] == pytest.approx(r, rel=1e-9)
        assert got[d]["p_value"] == pytest.approx(p, rel=1e-8) and got[d]["std_err"] == pytest.approx(se, rel=1e-8)


def test_regression_edge_cases(spark):
    df = spark.createDataFrame([("one", 1, 2.0), ("flat", 1, 3.0), ("flat", 2, 3.0), ("two", 1, 1.0), ("two", 2, 5.0)], "g string, x int, v double")
    got = {r["g"]: r for r in trend.regress(df, ["g"], "x", F.col("v")).collect()}
    assert got["one"]["slope"] is None
    assert (got["flat"]["slope"], got["flat"]["correlation"], got["flat"]["p_value"]) == (0.0, 0.0, 1.0)
    assert got["two"]["slope"] == 4.0 and got["two"]["p_value"] == 0.0


@pytest.mark.parametrize("m,acc,f1,prec,rec,macro", [
    ([[135, 15], [24, 576]], 0.948, 0.9672544080604534, None, None, None),
    ([[1793, 1207], [467, 11532]], 0.8883925595039669, None, 0.7933628318584071, 0.5976666666666667, 0.8070399382486635)])
def test_golden_confusion_metrics(spark, m, acc, f1, prec, rec, macro):
    conf = spark.createDataFrame([(1, i, j, m[i][j]) for i in (0, 1) for j in (0, 1)], "g int, label int, prediction int, n long")
    b = evaluate.binary_report(conf, ["g"], F.col("label") == 1, F.col("prediction") == 1).first()
    assert b["accuracy"] == pytest.approx(acc)
    if f1:
        assert b["f1"] == pytest.approx(f1)
    else:
        c = {r["class"]: r for r in evaluate.class_report(conf, ["g"]).collect()}
        assert c["0"]["precision"] == pytest.approx(prec) and c["0"]["recall"] == pytest.approx(rec) and c["macro avg"]["f1"] == pytest.approx(macro)


def test_binomial_tails_against_sums():
    for n in (1, 2, 7, 40, 311):
        for k in {0, 1, n // 2, n - 1, n}:
            ge, le = pvalues.binomial_tails([k], [n])
            assert ge[0] == pytest.approx(sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n, rel=1e-10)
            assert le[0] == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel=1e-10)
    ge, _ = pvalues.binomial_tails([50_000_000_000 + 400_000], [100_000_000_000])
    assert ge[0] == pytest.approx(0.5 * math.erfc(2.52982 / math.sqrt(2)), rel=1e-3)


def test_rank_tests_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("g", rng.randint(0, 12), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, first boolean")
    a, b = [v for _, v, f in rows if f], [v for _, v, f in rows if not f]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert ranks.mann_whitney(df, ["g"], "v", F.col("first")).first()["u"] == u
    assert ranks.roc_auc(df, ["g"], "v", F.col("first")).first()["auc"] == pytest.approx(u / len(a) / len(b))
    d = max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t in range(13))
    assert ranks.kolmogorov_smirnov(df, ["g"], "v", F.col("first")).first()["d"] == pytest.approx(d)


def test_mean_roc_matches_numpy_interpolation(spark):
    rng = random.Random(9)
    rows = [(0, f, round(rng.random(), 1), rng.random() < 0.5) for f in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, fold int, s double, y boolean")
    got = {round(r["fpr"] * 99): r["mean_tpr"] for r in ranks.mean_roc(ranks.roc_segments(df, ["g", "fold"], "s", F.col("y")), ["g"], "fold").collect()}
    grid, total = np.linspace(0, 1, 100), np.zeros(100)
    for f in range(3):
        s = np.array([r[2] for r in rows if r[1] == f])
        y = np.array([r[3] for r in rows if r[1] == f])
        pts = [(0.0, 0.0)] + [(((s >= t) & ~y).sum() / (~y).sum(), ((s >= t) & y).sum() / y.sum()) for t in sorted(set(s), reverse=True)]
        t = np.interp(grid, [p[0] for p in pts], [p[1] for p in pts])
        t[0] = 0.0
        total += t / 3
    assert len(got) == 100
    for i in range(100):
        assert got[i] == pytest.approx(total[i]), i


def test_pairwise_differences_without_pairs(spark):
    rng = random.Random(3)
    rows = [("g", rng.randint(0, 60), rng.random() < 0.5, -70, 5) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, value int, h boolean, low int, width int")
    pairs = [a[1] - b[1] for a in rows if a[2] for b in rows if not b[2]]
    want = [0] * 28
    for d in pairs:
        want[min((d + 70) // 5, 27)] += 1
    got = compare.pair_difference_histogram(df, ["g"], F.col("h"), "value", "low", "width", 28).orderBy("bin").collect()
    assert [r["n"] for r in got] == want
    s = compare.pair_difference_summary(df, ["g"], F.col("h")).first()
    assert s["n_pairs"] == len(pairs) and s["mean_difference"] == pytest.approx(np.mean(pairs)) and s["variance"] == pytest.approx(np.var(pairs))


def test_overall_row_is_not_a_null_group(spark):
    df = spark.createDataFrame([(None, 1), ("a", 0), ("a", 1)], "g string, human_wins int")
    got = {r["g"]: r["n_comparisons"] for r in compare.win_summary_with_overall(df, "g").collect()}
    assert got == {None: 1, "a": 2, "OVERALL": 3}


def test_matching_drops_null_keys_and_values(spark):
    df = spark.createDataFrame([("N", "d", 1, "f", 2.0), ("A", "d", 1, "f", 1.0), ("R", "d", 1, "f", None), ("N", None, 2, "f", 1.0), ("A", None, 2, "f", 1.0)],
                               "model string, domain string, a int, feature string, value double")
    got = compare.matched_comparison(df, ["domain", "a"], F.col("model") == "N").collect()
    assert [(r["model"], r["human_wins"]) for r in got] == [("A", 1)]


def test_moments_are_stable_for_large_means(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), (F.col("id") * F.col("id") % 13 + 1e9).alias("x")).repartition(7)
    got = trend.moments(df, ["k"], ["x"]).first()
    v = [i * i % 13 for i in range(100)]
    assert got["m2"] / 100 == pytest.approx(np.var(v)) and got["mean"] == pytest.approx(1e9 + np.mean(v))


def test_top_n_equals_the_plain_window(spark):
    from wayline.operators.ordered import top_n

    df = spark.range(2000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 37 % 101).alias("v"))
    got = top_n(df, ["g"], [F.desc("v"), F.col("id")], 30, salt="id").collect()
    want = {g: sorted(((-(i * 37 % 101), i) for i in range(2000) if i % 2 == g))[:30] for g in (0, 1)}
    for g in (0, 1):
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["_rank"])] == [i for _, i in want[g]]


def test_exact_splits_keep_class_shares(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = {(r["y"], r["is_train"]): r["count"] for r in split.split(df, "id", "y", 0.7, exact=True).groupBy("y", "is_train").count().collect()}
    assert s[(1, True)] == 24 and s[(0, True)] == 47
    f = split.folds(df, "id", "y", exact=True).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in f if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1
    again = split.split(df.repartition(5), "id", "y", 0.7, exact=True).where("is_train").select("id")
    assert again.exceptAll(split.split(df, "id", "y", 0.7, exact=True).where("is_train").select("id")).count() == 0


def test_rank_sum_tail_against_all_subsets():
    for n1 in range(1, 9):
        for n2 in (1, 2, 3, 5, 8):
            if n1 + n2 > 13:
                continue
            sums = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
            for u in range(0, n1 * n2 + 1):
                assert pvalues.rank_sum_tail(n1, n2, u) == pytest.approx(sum(x <= u for x in sums) / len(sums), rel=1e-12)
    assert pvalues.rank_sum_tail(8, 900, 3600) == pytest.approx(0.5, abs=1e-3)


def test_paths_inside_against_all_orders():
    for m, n in ((1, 1), (2, 3), (3, 3), (4, 6), (5, 4), (7, 5)):
        gaps = []
        for c in itertools.combinations(range(m + n), m):
            i = j = most = 0
            for t in range(m + n):
                i, j = (i + 1, j) if t in c else (i, j + 1)
                most = max(most, abs(i * n - j * m))
            gaps.append(most)
        for h in range(1, m * n + 1):
            assert pvalues.paths_inside(m, n, h) == pytest.approx(sum(g < h for g in gaps) / len(gaps), rel=1e-12, abs=1e-15)


def test_finite_distance_distribution():
    """Known exact values, agreement of the forms where they meet, and of large samples with the limit."""
    assert 1 - pvalues._matrix_form(10, 0.274) == pytest.approx(1 - 0.6284796154565, abs=1e-10)
    assert pvalues._matrix_form(1, 0.75) == pytest.approx(0.5) and pvalues._matrix_form(2, 0.5) == pytest.approx(0.5)
    for d in (0.05, 0.08, 0.1, 0.14):
        assert pvalues._expansion(140, d) == pytest.approx(pvalues._matrix_form(140, d), abs=2e-5)
    assert 2 * pvalues._one_sided_tail(140, 0.17) == pytest.approx(1 - pvalues._matrix_form(140, 0.17), rel=1e-3)
    z = 0.9
    limit = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 50))
    assert pvalues.kolmogorov_tail(10**8, z / 10**4) == pytest.approx(limit, abs=1e-4)


def test_exact_p_of_groups(spark):
    rows = [("a", 1.0, True), ("a", 2.0, False), ("a", 3.0, False), ("b", 1.0, True), ("b", 1.0, False), ("c", 5.0, True)]
    df = spark.createDataFrame(rows, "g string, v double, first boolean")
    mw = {r["g"]: r["p_value"] for r in ranks.mann_whitney(df, ["g"], "v", F.col("first")).collect()}
    ks = {r["g"]: r["p_value"] for r in ranks.kolmogorov_smirnov(df, ["g"], "v", F.col("first")).collect()}
    assert mw["a"] == pytest.approx(2 / 3) and mw["c"] is None
    assert ks["a"] == pytest.approx(2 / 3) and ks["b"] == 1.0 and ks["c"] is None


def test_binomial_tails_of_millions():
    n = np.array([11.0, 100_001.0, 7_200_001.0])
    assert np.abs(pvalues.binomial_tails((n + 1) / 2, n)[0] - 0.5).max() < 1e-12  # by symmetry
    # Sum of exact terms to 50 digits: half of the central term's rest less the terms in between.
    assert abs(pvalues.binomial_tails(np.array([3_600_940.0]), np.array([7_200_000.0]))[0][0] - 0.24188186454787783) < 1e-12


def test_slope_within_noise_is_stable(spark):
    rows = [("tie", 1, 0.1 + 0.2), ("tie", 2, 0.3), ("up", 1, 0.3), ("up", 2, 0.3 + 1e-9), ("flat", 1, 5.0), ("flat", 2, 5.0), ("one", 1, 1.0)]
    d = spark.createDataFrame(rows, "k string, year int, difference double")
    got = {r["k"]: r["trend"] for r in trend.convergence(d, ["k"]).collect()}
    assert got == {"tie": "flat", "up": "diverging", "flat": "flat", "one": "insufficient"}
    s = {r["k"]: r["slope"] for r in trend.regress(d, ["k"], "year", F.col("difference")).collect()}
    assert s["tie"] == 0 and s["up"] > 0


def test_equal_values_win_nothing(spark):
    rows = [("a", "N", 0.1 + 0.2, 1.0), ("a", "A", 0.3, 1.0 - 1e-9), ("b", "N", 0.3, 2.0), ("b", "A", 0.1 + 0.2, 3.0)]
    wide = spark.createDataFrame(rows, "author string, model string, x double, y double")
    got = {r["feature"]: (r["n"], r["human_wins"]) for r in compare.win_counts(wide, ["author"], ["x", "y"], F.col("model") == "N", []).collect()}
    assert got == {"x": (2, 0), "y": (2, 1)}
    long = compare.matched_wide(wide, ["author"], ["x", "y"], F.col("model") == "N")
    assert [r["human_wins"] for r in long.orderBy("author", "feature").collect()] == [0, 1, 0, 0]
    tall = wide.unpivot(["author", "model"], ["x", "y"], "feature", "value")
    assert [r["human_wins"] for r in compare.matched_comparison(tall, ["author"], F.col("model") == "N").orderBy("author", "feature").collect()] == [0, 1, 0, 0]
