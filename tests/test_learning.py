import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import batched, knn, linear, models, tfidf


def points(spark, n, seed, dims=3, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if copies:
        x[:copies] = x[0]
    return x, spark.createDataFrame([(i, [float(v) for v in r], int(r[0] > 0)) for i, r in enumerate(x)], "id long, vec array<double>, y int")


@pytest.mark.parametrize("copies", [0, 150])
def test_nearest_neighbours_against_brute_force(spark, copies):
    """``copies`` equal training rows make one cell hot; small chunks split it."""
    a, train = points(spark, 400, 1, copies=copies)
    b, test = points(spark, 60, 2)
    got = knn.nearest(train, test, "id", "vec", "y", k=5, n_pivots=8, chunk=32)
    near = {}
    for r in got.collect():
        near.setdefault(r["id"], []).append((r["_d"], r["_nid"]))
    for i in range(60):
        d = np.sqrt(((a - b[i]) ** 2).sum(1))
        want = sorted(zip(d, range(400)))[:5]
        assert [x[1] for x in sorted(near[i])] == [x[1] for x in want]


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([("d", 1, "apple apple pear"), ("d", 2, "pear plum x"), ("e", 3, "kiwi")], "domain string, id int, text string")
    w = {(r["id"], r["term"]): r["weight"] for r in tfidf.tfidf(docs, "domain", "id").collect()}
    idf1, idf2 = np.log(3 / 2) + 1, 1.0
    v = np.array([2 * idf1, idf2])
    assert w[(1, "apple")] == pytest.approx(v[0] / np.linalg.norm(v)) and w[(3, "kiwi")] == 1.0 and (2, "x") not in w
    few = tfidf.tfidf(docs, "domain", "id", max_features=1).select("id", "term").collect()
    assert {(r["id"], r["term"]) for r in few} == {(1, "apple"), (3, "kiwi")}


def test_svd_invariants(spark):
    rng = np.random.default_rng(0)
    m = rng.random((12, 7))
    rows = [(i, f"t{j}", float(m[i, j])) for i in range(12) for j in range(7)]
    scores, s, _ = tfidf.truncated_svd(spark.createDataFrame(rows, "id int, term string, weight double"), "id", 3)
    u, sv, vt = np.linalg.svd(m, full_matrices=False)
    assert s == pytest.approx(list(sv[:3]), rel=1e-6)
    got = np.array([r["vec"] for r in scores.orderBy("id").collect()])
    assert got @ got.T == pytest.approx((u[:, :3] * sv[:3]) @ (u[:, :3] * sv[:3]).T, abs=1e-6)


def test_pca_is_centred(spark):
    x, df = points(spark, 80, 4)
    df = df.select("id", *[(F.col("vec")[i] * (i + 1) + 100).alias(f"f{i}") for i in range(3)])
    pc, share = linear.principal_components(df, ["f0", "f1", "f2"], ["id"])
    z = (x - x.mean(0)) / x.std(0)
    ev = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert share == pytest.approx(list((ev / ev.sum())[:2]), rel=1e-6)
    assert pc.agg(F.avg("pc1")).first()[0] == pytest.approx(0, abs=1e-9)


def test_permutation_keeps_values(spark):
    df = spark.range(200).select("id", (F.col("id") * 3).cast("double").alias("x"))
    p = models.permuted(df, "id", ["x"], 3, 7).cache()
    assert p.count() == 600
    for repeat in range(3):
        assert sorted(r["x"] for r in p.where(F.col("repeat") == repeat).select("_other.x").collect()) == sorted(r["x"] for r in df.collect())
    assert p.where(F.col("_other.x") != F.col("x")).count() > 500


def test_wald_table_finds_the_signal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int")
    t = {r["feature"]: r for r in models.wald_table(df, ["a", "b"], "y").collect()}
    assert t["a"]["p_value"] < 1e-6 and t["a"]["coef"] > 1 and t["b"]["p_value"] > 1e-4 and t["a"]["odds_ratio"] == pytest.approx(np.exp(t["a"]["coef"]))


def test_pipeline_beats_the_majority(spark):
    _, df = points(spark, 300, 6)
    d = df.select("id", "y", *[F.col("vec")[i].alias(f"f{i}") for i in range(3)]).withColumn("f1", F.when(F.col("id") % 5 != 0, F.col("f1")))
    r = models.static_validation(d, ["f0", "f1", "f2"], "y", "id").first()
    assert r["accuracy"] > 0.9 and r["auc"] > 0.95 and r["n_train"] + r["n_test"] == 300
    assert models.static_validation(d.where("y = 1"), ["f0"], "y", "id").count() == 0


def irls(x, y, w, ridge):
    z = np.c_[x, np.ones(len(x))]
    pull, b = np.r_[np.full(x.shape[1], ridge), 0.0], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        h = (z.T * (w * p * (1 - p))) @ z + np.diag(pull)
        b = b + np.linalg.solve(h, z.T @ (w * (y - p)) - pull * b)
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.mark.parametrize("ridge,balanced", [(1.0, True), (0.0, False)])
def test_batched_regressions_against_one_by_one(spark, ridge, balanced):
    """Every slice and fold next to a fit of its own, with missing values; a slice of one class is left out."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        s = "abc"[i % 3] if i % 50 else None
        x = rng.normal([5, -2, 1e4], [1, 3, 50])
        y = int(s != "c" and rng.random() < 1 / (1 + np.exp(-(x[0] - 5 + (s == "a") * x[1] / 3))))
        rows.append((i, s, *[None if rng.random() < 0.1 else float(v) for v in x], y))
    df = spark.createDataFrame(rows, "id int, s string, f0 double, f1 double, f2 double, y int")
    parted, slices = batched.prepared(df.withColumnRenamed("s", "part"), ["part"], ["f0", "f1", "f2"], "y", "id")
    assert slices == [("a",), ("b",)]
    fitted = batched.regress(parted, slices, ["part"], ["f0", "f1", "f2"], 5, ridge, balanced)
    local = parted.toPandas()
    for key, fit in fitted.fits.items():
        own = local[(local.s == key // 6) & (local.fold >= 0) & (local.fold != key % 6 - 1)]
        x = np.array(own.x.tolist(), float)
        x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
        y = own.label.to_numpy()
        w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum()) if balanced else np.ones(len(y))
        b, e = irls((x - x.mean(0)) / x.std(0), y, w, ridge)
        assert fit.n == len(y) and not fit.open and fit.beta == pytest.approx(b, abs=1e-7) and fit.errors == pytest.approx(e, rel=1e-6)
    assert len(fitted.fits) == 12
    assert batched.first_order(fitted, parted, ridge, balanced).agg(F.max("gradient")).first()[0] < 1e-9
    scored = fitted.scored(parted).toPandas()
    assert len(scored) == len(local) and ((scored.score > 0.5) == (scored.prediction == 1)).all()


def test_a_separated_slice_is_not_settled(spark):
    df = spark.createDataFrame([(i, "a", float(i), int(i >= 20)) for i in range(40)], "id int, s string, f double, y int")
    rows, slices = batched.prepared(df.withColumnRenamed("s", "part"), ["part"], ["f"], "y", "id", train_share=None, k=2)
    fitted = batched.regress(rows, slices, ["part"], ["f"], 2, ridge=0.0, balanced=False, rounds=8)
    assert all(f.open and f.rounds == 8 for f in fitted.fits.values())
    assert not fitted.coefficients(spark).where("settled").count()
    assert batched.prepared(df.limit(0).withColumnRenamed("s", "part"), ["part"], ["f"], "y", "id")[1] == []


def test_exact_selection_against_sorting(spark):
    from wayline.operators import ordered, split

    df = spark.range(30_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    hashed = df.withColumn("h", F.concat(split.id_hash(F.col("id"), 1), F.col("id").cast("string")))
    local = sorted((r.y, r.h) for r in hashed.collect())
    for share in (0.0, 0.37, 1.0):
        for limit in (20_000, 3):
            before, ordered.BLOCK_ROWS = ordered.BLOCK_ROWS, limit
            try:
                cuts = {r["y"]: r["_cut"] for r in ordered.hash_cuts(hashed, "y", "h", share).collect()}
                ranks_ = {r["id"]: r["_rank"] for r in ordered.global_rank(hashed, ["y"], "h").where("id % 1000 = 7").collect()}
            finally:
                ordered.BLOCK_ROWS = before
            for y in (0, 1):
                own = [h for k, h in local if k == y]
                assert sum(h < cuts[y] for h in own) == int(len(own) * share)
    place = {h: i for y in (0, 1) for i, h in enumerate(h for k, h in local if k == y)}
    assert len(ranks_) == 30 and all(place[r.h] == ranks_[r.id] for r in hashed.where("id % 1000 = 7").collect())


@pytest.mark.parametrize("summary,distinct,most", [(4, 1_000_000, 30), (1, 40, 30), (1, 5, 7), (4, 1_000_000, 1000)])
def test_vocabulary_from_summaries(spark, monkeypatch, summary, distinct, most):
    """Small summaries leave terms out; the vocabulary is still the exact one."""
    monkeypatch.setattr(tfidf, "SUMMARY", summary)
    monkeypatch.setattr(tfidf, "DISTINCT", distinct)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{min(int(v), 400)}" for v in rng.zipf(1.3, 60)) for _ in range(90)]
    rows = [("de"[i % 2], i, t) for i, t in enumerate(texts)] + [("d", 100, None), ("d", 101, ""), (None, 102, "ab cd")]
    docs = spark.createDataFrame(rows, "domain string, id int, text string").repartition(6)
    lists = tfidf.term_lists(docs, "domain", "id").cache()
    got = {(r["domain"], r["term"]): r["df"] for r in tfidf.vocabulary(lists, "domain", most).collect() if r["domain"]}
    for d in "de":
        total, df = {}, {}
        for dom, _, t in rows:
            if dom == d:
                for w in (t or "").split():
                    total[w] = total.get(w, 0) + 1
                for w in set((t or "").split()):
                    df[w] = df.get(w, 0) + 1
        want = sorted(total, key=lambda w: (-total[w], w))[:most]
        assert {t: n for (x, t), n in got.items() if x == d} == {w: df[w] for w in want}


def test_prepared_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    df = spark.range(400).selectExpr("cast(id as string) AS id", "'a' AS level", "cast(id % 2 as int) AS target", "cast(id % 7 as double) AS x")
    rows, slices = batched.prepared(df.mapInPandas(counted, df.schema), ["level"], ["x"], "target", "id")
    assert rows.count() == 400 and slices == [("a",)]
    assert read.value == 400


def test_svd_tasks_do_not_grow_with_partitions(spark):
    rows = spark.range(1000).repartition(300)
    assert tfidf._gathered(rows).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert tfidf._gathered(rows).count() == 1000


def test_svd_of_all_domains_at_once(spark):
    rng = np.random.default_rng(5)
    shapes, rows, whole = {"a": (60, 35), "b": (8, 50), "c": (30, 4), "d": (5, 1)}, [], {}
    for d, (n, m) in shapes.items():
        whole[d] = rng.random((n, m)) * (rng.random((n, m)) < 0.5)
        rows += [(d, i, [int(j) for j in np.flatnonzero(whole[d][i])], [float(x) for x in whole[d][i][whole[d][i] > 0]]) for i in range(n)]
    df = spark.createDataFrame(rows, "domain string, id int, at array<int>, weight array<double>").repartition(5)
    svd = tfidf.sparse_svd(df, "domain", {d: list(map(str, range(m))) for d, (_, m) in shapes.items()}, 6)
    vec = {(r["domain"], r["id"]): r["vec"] for r in tfidf.projected(df, "domain", "id", svd).collect()}
    for d, x in whole.items():
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        k = min(6, x.shape[1])
        assert svd.values[d][: len(s)] == pytest.approx(s[:k], abs=1e-7) and len(svd.values[d]) == k
        assert svd.vectors[d].T @ svd.vectors[d] == pytest.approx(np.eye(k), abs=1e-8)
        got = np.array([vec[d, i] for i in range(len(x))])
        assert got @ got.T == pytest.approx((u[:, :k] * s[:k]) @ (u[:, :k] * s[:k]).T, abs=1e-6)


def test_keyed_bijection():
    from wayline.operators.permute import permuted_numbers

    for n in (1, 2, 3, 7, 64, 65, 1000):
        for key in range(4):
            assert sorted(permuted_numbers(np.arange(n), n, key).tolist()) == list(range(n))
    a, b = permuted_numbers(np.arange(5000), 5000, 1), permuted_numbers(np.arange(5000), 5000, 2)
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.06 and abs(np.corrcoef(a, b)[0, 1]) < 0.06
    # Each place is about as often the image of a number as any other.
    first = np.array([permuted_numbers(np.array([0]), 10, k)[0] for k in range(4000)])
    assert np.abs(np.bincount(first, minlength=10) / 400 - 1).max() < 0.2


def clusters(rng, n, groups, dims=4):
    return np.concatenate([rng.normal(c, 0.05, (n // groups, dims)) for c in rng.normal(0, 10, (groups, dims))])


def test_pivot_tree_against_all_distances():
    rng = np.random.default_rng(8)
    for points_ in (rng.normal(size=(70, 3)), clusters(rng, 90, 9), np.zeros((20, 2)), rng.normal(size=(1, 5))):
        x = np.concatenate([points_[:10], rng.normal(0, 8, (40, points_.shape[1]))])
        tree = knn.PivotTree(points_)
        far = np.sqrt(((x[:, None] - points_[None]) ** 2).sum(-1))
        cell, d = tree.nearest(x)
        assert d == pytest.approx(far.min(1)) and far[np.arange(len(x)), cell] == pytest.approx(far.min(1))
        radius = {i: (float(rng.random()), int(rng.integers(1, 9))) for i in range(len(points_))}
        row, cell, looked = tree.filled(radius).reach(x, far.min(1) + 0.5, 5)
        got = set(zip(row.tolist(), cell.tolist()))
        upper = np.array([min([far[i].min() + 0.5] + [far[i, c] + r for c, (r, n) in radius.items() if n >= 5]) for i in range(len(x))])
        must = {(i, c) for i in range(len(x)) for c, (r, _) in radius.items() if far[i, c] - r <= min(upper[i], far[i].min() + 0.5) - 1e-6 and far[i, c] <= far[i].min() + 0.5}
        assert {(i, c) for i, c in must if far[i, c] + radius[c][0] <= upper[i]} <= got and (looked > 0).all()


def test_neighbours_in_clusters_visit_few_cells(spark):
    rng = np.random.default_rng(3)
    a = clusters(rng, 4000, 40)
    b = clusters(np.random.default_rng(3), 400, 40)
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "id long, vec array<double>, y int")
    train, test = frame(a), frame(b)
    near = {}
    for r in knn.nearest(train, test, "id", "vec", "y").collect():
        near.setdefault(r["id"], []).append((r["_d"], r["_nid"]))
    for i in range(0, 400):
        d = np.sqrt(((a - b[i]) ** 2).sum(1))
        assert [x[1] for x in sorted(near[i])] == [x[1] for x in sorted(zip(d, range(4000)))[:5]]
    means = []
    for n_pivots in (63, 250):
        v = knn.visited_cells(train, test, "id", "vec", "y", n_pivots=n_pivots).toPandas()
        assert len(v) == 400
        means.append((v["visited"].mean() / v["cells"].iloc[0], v["measured"].mean() / v["cells"].iloc[0]))
    assert means[1][0] < 0.1 and means[1][1] < means[0][1] < 1.2 and means[1][1] < 0.6


def test_neighbours_when_cells_are_smaller_than_k(spark):
    x, train = points(spark, 30, 9)
    got = knn.nearest(train, train.limit(10), "id", "vec", "y", k=8, n_pivots=15).groupBy("id").count().collect()
    assert len(got) == 10 and all(r["count"] == 8 for r in got)
    few = knn.nearest(train.limit(3), train.limit(2), "id", "vec", "y", k=8).groupBy("id").count().collect()
    assert [r["count"] for r in few] == [3, 3]


def test_cells_keep_their_size_as_rows_grow():
    assert [knn.pivots_for(n) for n in (0, 1, 100, 1 << 20)] == [1, 1, 10, 1024]
    assert all(n / knn.pivots_for(n) <= knn.CELL for n in (1 << 20, 10_000_000, 60_000_000))


def test_equal_distances_go_by_id(spark):
    rows = [(i, [float(i % 2), 0.0], i % 3) for i in range(40)]
    train = spark.createDataFrame(rows, "id long, vec array<double>, y int")
    got = knn.nearest(train, train.where("id < 2"), "id", "vec", "y", k=5, n_pivots=2, chunk=7)
    near = {r["id"]: sorted(r["ids"]) for r in got.groupBy("id").agg(F.collect_list("_nid").alias("ids")).collect()}
    assert near == {0: [0, 2, 4, 6, 8], 1: [1, 3, 5, 7, 9]}
