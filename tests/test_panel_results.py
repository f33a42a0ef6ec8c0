"""Reports on the author experiment wait for what they read; rows that cannot be near are not measured."""

import numpy as np
import pytest

from wayline.operators import knn, models
from wayline.plans import learning, reports  # noqa: F401
from wayline.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fitted(spark, monkeypatch, tmp_path):
    """(feature set, with importances) of every panel that is fitted, in place of the fits; an empty store."""
    calls = []

    def fit_panel(train, test, features, key, importance=False, **_):
        calls.append((len(features), importance))
        rows = test.sparkSession.createDataFrame([(m, float(y), float(y), y * 0.5) for m in ("A", "B") for y in (0, 1)], "model string, label double, prediction double, score double")
        weights = test.sparkSession.createDataFrame([(m, f, 0.25) for m in ("A", "B") for f in features], "model string, feature string, importance double")
        return rows, weights if importance else None

    monkeypatch.setattr(models, "fit_panel", fit_panel)
    monkeypatch.setattr(learning.store, "fingerprint", lambda _: tmp_path.name + "-panel-test")
    return calls


@pytest.mark.parametrize("name", ["E24_panel_importance_of_best_models", "E25_panel_importance_by_type", "F17_panel_competition_rank", "F18_panel_sequential_rank", "G3_panel_top_per_group"])
def test_importances_wait_for_single_statistics_only(spark, fitted, name):
    assert REGISTRY[name].run(spark, SF).count()
    assert fitted == [(4, True)] * 3


def test_accuracies_wait_for_no_importances(spark, fitted):
    assert {r["statistic"] for r in REGISTRY["G4_best_panel_model"].run(spark, SF).collect()} == set(learning.EVERY)
    assert sorted(fitted) == [(4, False)] * 3 + [(12, False)]
    REGISTRY["K20_author_experiment"].run(spark, SF).collect()
    assert len(fitted) == 4
    REGISTRY["K14_panel_importances"].run(spark, SF).collect()
    REGISTRY["G3_panel_top_per_group"].run(spark, SF).collect()
    assert sorted(fitted) == [(4, False)] * 3 + [(4, True)] * 3 + [(12, False)]


def test_far_variants_measure_few_rows(monkeypatch):
    """A variant whose new value leads away from the rows near without it is measured against those within its bound, not against all."""
    rng = np.random.default_rng(1)
    tx = rng.normal(size=(20_000, 4))
    measured, plain = [], np.partition
    monkeypatch.setattr(knn.np, "partition", lambda a, *x, **y: (measured.append(a.size), plain(a, *x, **y))[1])
    for _ in range(5):
        knn._variant_neighbours(rng.normal(size=4), 2 * rng.normal(size=(10, 4)), tx, 5)
    assert sum(measured) < 500_000
