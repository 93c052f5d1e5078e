"""Moving-window correlations against each window's own."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import knn, rolling
from tessera.operators.blocks import Measure


def plain(window):
    """A window's vectors: deviations from the entity's own mean, missing ones 0, of length 1."""
    held = ~np.isnan(window)
    mean = np.where(held, window, 0).sum(axis=0) / np.maximum(held.sum(axis=0), 1)
    v = np.where(held, window - mean, 0.0)
    norm = np.sqrt((v * v).sum(axis=0))
    return v / np.where(norm < 1e-12, 1.0, norm)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 3, 12, 30]), st.booleans(), st.sampled_from([0.0, 1e4]))
def test_updates_equal_whole_windows(seed, window, missing, level):
    rng = np.random.default_rng(seed)
    x, y = (rng.normal(size=(window - 1 + 40, n)) + level for n in (5, 7))
    x[:, 0] = 3.0
    y[10:, 1] = 2.0
    if missing:
        for v in (x, y):
            v[rng.random(v.shape) < 0.3] = np.nan
    for p, got in enumerate(rolling.correlations(x, y, window)):
        want = plain(x[p : p + window]).T @ plain(y[p : p + window])
        assert np.allclose(got, want, atol=1e-8 if level else 1e-11)
        assert (got[0] == 0).all()


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=(75, 3))
    x = common @ rng.normal(size=(3, 24)) + 0.5 * rng.normal(size=(75, 24))
    rows = [(t, 10 * i - 100, None if rng.random() < 0.1 else float(x[t, i])) for t in range(75) for i in range(24)]
    return spark.createDataFrame(rows, "t int, id long, y double").repartition(4)


def edges(df):
    return {(r["t"], r["src"], r["dst"]): round(r["w"], 8) for r in df.collect()}


@pytest.mark.parametrize("k,threshold,absolute", [(4, None, False), (None, 0.8, False), (3, None, True), (None, 0.9, True)])
def test_all_paths_give_the_same_edges(returns, k, threshold, absolute):
    found = [edges(knn.return_corr_graph(returns, 12, k, threshold, absolute, digits=9, path=p, symmetric=False, row_norm=False)) for p in ("rolling", "block", "sql")]
    assert len(found[0]) > 100 and found[0] == found[1] == found[2]


def test_small_runs_and_blocks_change_nothing(returns):
    whole = rolling.correlated(returns, 12, Measure(False, digits=9, k=4), 24)
    parts = rolling.correlated(returns, 12, Measure(False, digits=9, k=4), 24, run=7, block=5)
    assert edges(knn.ranked(whole, 4, True).withColumnRenamed("score", "w")) == edges(knn.ranked(parts, 4, True).withColumnRenamed("score", "w"))


def test_gaps_short_periods_and_nothing(spark, returns):
    gappy = returns.where("NOT (id = -100 AND t BETWEEN 20 AND 29)")
    got = edges(knn.return_corr_graph(gappy, 5, None, -1.0, path="rolling", symmetric=False, row_norm=False))
    assert not any(20 <= t <= 29 and -100 in (a, b) for t, a, b in got) and any(t == 30 and a == -100 for t, a, b in got) is False
    assert any(t == 32 and a == -100 for t, a, b in got), "two values in the window do"
    with pytest.raises(ValueError, match="every period"):
        knn.return_corr_graph(returns, 12, 24)
    assert knn.return_corr_graph(returns.where("t > 99"), 12, 3).count() == 0


def test_blocks_hand_on_the_k_best_alone(returns):
    """Not the k best of each pair of blocks, and nothing for runs that hold but the window before them."""
    rows = returns.where("t < 30")
    found = rolling.correlated(rows, 12, Measure(False, digits=9, k=4), 24, block=5)
    counts = found.groupBy("t", "src").count().agg({"count": "max"}).first()[0]
    assert counts == 4 and found.agg({"t": "max"}).first()[0] == 29
    assert edges(found.withColumnRenamed("score", "w")) == edges(knn.return_corr_graph(rows, 12, 4, digits=9, path="sql", symmetric=False, row_norm=False))


@pytest.mark.parametrize("k,threshold,absolute", [(4, None, False), (None, 0.3, True)])
def test_long_windows_are_updated(returns, monkeypatch, k, threshold, absolute):
    """The path of windows over WHOLE gives the same edges."""
    found = []
    for whole in (400, 1):
        monkeypatch.setattr(rolling, "WHOLE", whole)
        found.append(edges(knn.return_corr_graph(returns, 12, k, threshold, absolute, digits=9, symmetric=False, row_norm=False)))
    assert len(found[0]) > 100 and found[0] == found[1]
