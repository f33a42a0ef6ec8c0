"""Neighbours of permuted test rows against brute force, within a block and over several."""

import numpy as np
import pytest

from wayline.operators import knn


def brute(tx, x, k):
    d = np.sqrt(((tx - x) ** 2).sum(axis=1))
    return np.lexsort((np.arange(len(tx)), d))[:k]


@pytest.mark.parametrize("near", [6, 40, 512])
def test_variants_against_brute_force(monkeypatch, near):
    """With few rows measured first most variants need the others as well; copies are ties, which the order of the rows decides."""
    monkeypatch.setattr(knn, "NEAR", near)
    rng = np.random.default_rng(2)
    tx = np.concatenate([rng.integers(0, 4, (40, 3)).astype(float), np.repeat(rng.normal(size=(30, 3)), 4, axis=0)])
    for _ in range(20):
        q, others = rng.integers(0, 4, 3) + rng.integers(0, 2) * rng.normal(size=3), rng.integers(0, 4, (4, 3)).astype(float)
        variant, row, d = knn._variant_neighbours(q, others, tx, 5)
        for v in range(12):
            x = q.copy()
            x[v % 3] = others[v // 3, v % 3]
            assert row[variant == v].tolist() == brute(tx, x, 5).tolist()
            assert d[variant == v] == pytest.approx(np.sqrt(((tx[row[variant == v]] - x) ** 2).sum(axis=1)))


@pytest.mark.parametrize("block", [knn.BLOCK, 25])
def test_blocks_are_merged(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    rng = np.random.default_rng(4)
    tx, qx, others = rng.normal(size=(90, 3)), rng.normal(size=(8, 3)), rng.normal(size=(8, 2, 3))
    train = spark.createDataFrame([(i, v.tolist(), float(i % 2)) for i, v in enumerate(tx)], "_id long, _a array<double>, _l double")
    test = spark.createDataFrame([(f"q{i}", v.tolist(), o.tolist()) for i, (v, o) in enumerate(zip(qx, others))], "_id string, _a array<double>, _rows array<array<double>>")
    got = knn.nearest_of_variants(train, test, "_id", "_a", "_rows", "_l", 5).collect()
    assert len(got) == 8 * 2 * 3
    for r in got:
        x = qx[int(r["_id"][1:])].copy()
        x[r["_j"]] = others[int(r["_id"][1:]), r["_rep"], r["_j"]]
        want = brute(tx, x, 5)
        assert [n["_nid"] for n in r["_near"]] == want.tolist() and [n["_nlabel"] for n in r["_near"]] == [i % 2 for i in want]


def test_fewer_rows_than_neighbours():
    variant, row, _ = knn._variant_neighbours(np.zeros(2), np.ones((1, 2)), np.array([[0.0, 1.0], [2.0, 2.0]]), 5)
    assert variant.tolist() == [0, 0, 1, 1] and row.tolist() == [0, 1, 0, 1]


def test_blocks_even_out():
    """Six copies of the smallest author table: a task that gets several blocks has a small share of the work."""
    tb, qb = knn._blocks(28_800, 7_200, 8)
    assert tb * qb >= 64
    assert knn._blocks(28_800, 3, 8) == (1, 3)
    assert knn._blocks(10_000_000, 1_000_000, 8)[1] == 977
