"""Neighbours by regions against brute force; what a query is measured against does not grow with the training rows."""

import numpy as np
import pytest

from wayline.operators import knn


def brute(tx, x, k):
    d = np.sqrt(((tx - x) ** 2).sum(axis=1))
    return np.lexsort((np.arange(len(tx)), d))[:k]


def test_near_rows_against_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(60):
        d, n, m = (int(rng.integers(1, top)) for top in (6, 900, 120))
        tx, qx = (rng.integers(0, 4, (s, d)).astype(float) if trial % 3 == 0 else rng.normal(size=(s, d)) * (1 + trial % 4) for s in (n, m))
        regions = knn.Regions(tx[:100], 5)
        assert (np.bincount(regions.places(regions.turned(tx)), minlength=regions.count) > 0).all()
        kth = np.array([np.sqrt(((tx[brute(tx, x, 5)[-1]] - x) ** 2).sum()) for x in qx])
        for bound in (np.full(m, np.inf), kth):
            query, row, far = knn._near_rows(qx, tx, regions.axes, 5, bound)
            for i in range(m):
                assert row[query == i].tolist() == brute(tx, qx[i], 5).tolist()
                assert far[query == i] == pytest.approx(np.sqrt(((tx[row[query == i]] - qx[i]) ** 2).sum(axis=1)))


def test_equal_rows_are_not_cut():
    regions = knn.Regions(np.repeat([[0.0, 0.0], [1.0, 1.0], [1.0, 2.0]], [500, 3, 2], axis=0), 8)
    assert regions.count == 3


def test_a_query_is_measured_against_few_rows(monkeypatch):
    rng = np.random.default_rng(1)
    tx, qx = rng.normal(size=(40_000, 4)), rng.normal(size=(2_000, 4)) * 0.3
    measured, plain, rough = [], np.partition, knn._rough
    monkeypatch.setattr(knn.np, "partition", lambda a, *x, **y: (measured.append(a.size), plain(a, *x, **y))[1])
    monkeypatch.setattr(knn, "_rough", lambda x, y: (measured.append(len(x) * len(y)), rough(x, y))[1])
    query, _, _ = knn._near_rows(qx, tx, np.eye(4), 5, np.full(len(qx), np.inf))
    assert len(query) == 5 * len(qx) and sum(measured) < len(qx) * 2_000


@pytest.mark.parametrize("least", [8, 4096])
def test_variants_by_regions(spark, monkeypatch, least):
    """Many small regions, rows that are equal, a row without numbers; a key that comes twice keeps two results."""
    monkeypatch.setattr(knn, "LEAST", least)
    rng = np.random.default_rng(4)
    tx, qx, others = np.concatenate([rng.normal(size=(150, 3)), np.zeros((60, 3))]), rng.normal(size=(12, 3)), rng.normal(size=(12, 2, 3))
    train = spark.createDataFrame([(i, v.tolist(), float(i % 2)) for i, v in enumerate(tx)], "_id long, _a array<double>, _l double")
    test = spark.createDataFrame([(f"q{i % 11}", i, v.tolist(), o.tolist()) for i, (v, o) in enumerate(zip(qx, others))], "_id string, n int, _a array<double>, _rows array<array<double>>")
    got = knn.nearest_of_variants(train, test, "_id", "_a", "_rows", "_l", 5).collect()
    assert len(got) == 12 * 2 * 3
    for r in got:
        mine = [i for i in range(12) if i % 11 == int(r["_id"][1:])]
        want = []
        for i in mine:
            x = qx[i].copy()
            x[r["_j"]] = others[i, r["_rep"], r["_j"]]
            want.append(brute(tx, x, 5).tolist())
        assert [n["_nid"] for n in r["_near"]] in want
        assert all(n["_nlabel"] == n["_nid"] % 2 for n in r["_near"])


def test_rows_without_numbers_take_no_part(spark):
    rows = [(i, [float(i), 0.0], i % 2) for i in range(30)] + [(90, None, 1), (91, [None, 1.0], 1), (92, [float("nan"), 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, y int")
    got = knn.nearest(df, df, "id", "vec", "y", k=2, n_pivots=4, chunk=5).collect()
    assert sorted({r["id"] for r in got}) == list(range(30)) and {r["_nid"] for r in got} <= set(range(30)) and len(got) == 60
    assert knn.nearest(df.where("id > 90"), df, "id", "vec", "y").count() == 0
