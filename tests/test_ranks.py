"""Ranks over ranges against windows, and the placebo graph's draws."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import knn, metrics, portfolio, ranks


@pytest.fixture(scope="module")
def scores(spark):
    """Six periods of very different size, 30 % of the rows with one score, some missing."""
    rng = np.random.default_rng(1)
    rows = []
    for t, n in enumerate([1, 2, 3, 50, 400, 6]):
        for i in range(n):
            pred = 0.5 if rng.random() < 0.3 else float(rng.integers(0, 40)) / 8
            rows += [(m, t, int(i), float(rng.normal()), None if rng.random() < 0.02 else pred) for m in ("a", "b")]
    return spark.createDataFrame(rows, "model string, t int, id long, y_true double, y_pred double").withColumn("a.b", F.lit(1)).repartition(7)


def test_ranks_equal_windows(scores):
    group = Window.partitionBy("model", "t")
    want = scores.select("model", "t", "id", (F.row_number().over(group.orderBy("y_pred", "id")) - 1).alias("rank0"), F.count(F.lit(1)).over(group).alias("size"))
    got = ranks.positions(scores, ["model", "t"], ["y_pred", "id"])
    assert got.columns == [*scores.columns, "rank0", "size"]
    assert {tuple(r) for r in got.select(want.columns).collect()} == {tuple(r) for r in want.collect()}
    want = scores.select("model", "t", "id", (F.rank().over(group.orderBy("y_pred")) + (F.count(F.lit(1)).over(Window.partitionBy("model", "t", "y_pred")) - 1) / 2).alias("rank"))
    got = metrics.with_average_rank(scores, "y_pred", "rank", ["model", "t"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_no_window_holds_a_period(scores):
    for df in (portfolio.quantile_bins(scores, 2), metrics.rank_ic(scores), portfolio.long_short(scores)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(model" not in plan and "windowspecdefinition(t" not in plan


def test_ranks_of_nothing(scores):
    assert portfolio.with_ranks(scores.where("t > 99")).count() == 0
    assert metrics.rank_ic(scores.where("t > 99")).count() == 0


@pytest.mark.parametrize("first", [0, -20, 4 * 10**18, -(2**63)])
def test_placebo_has_k_different_targets_for_any_ids(spark, first):
    rows = [(t, first + 3 * i) for t, n in ((0, 40), (1, 7), (2, 1)) for i in range(n)]
    edges = knn.random_null_graph(spark.createDataFrame(rows, "t int, id long"), 5).collect()
    assert len(edges) == len({(r.t, r.src, r.dst) for r in edges}) == 40 * 5 + 7 * 5 + 1
    known = set(rows)
    assert all((r.t, r.src) in known and (r.t, r.dst) in known and r.w == 1 for r in edges)
    assert {r.src for r in edges if r.t == 0} == {i for t, i in rows if t == 0}


def test_placebo_is_uniform(spark):
    n, k = 900, 10
    nodes = spark.range(n).select(F.lit(3).alias("t"), "id")
    edges = knn.random_null_graph(nodes, k).toPandas()
    into = np.bincount(edges["dst"], minlength=n)
    # in-degrees are sums of n draws with chance k / n: mean k, variance k (1 - k / n)
    assert into.sum() == n * k and abs(into.var() / (k * (1 - k / n)) - 1) < 0.2 and into.max() < k + 6 * k**0.5
    steps = np.bincount((edges["dst"] - edges["src"]) % n, minlength=n)
    assert steps.max() < k + 6 * k**0.5, "not a union of shifts"
    other = knn.random_null_graph(nodes, k, seed=7).toPandas()
    assert len(edges.merge(other, on=["src", "dst"])) < 4 * k * k + 60


def test_placebo_of_nothing(spark):
    nodes = spark.createDataFrame([], "t int, id long")
    assert knn.random_null_graph(nodes, 3).count() == 0
    with pytest.raises(ValueError):
        knn.random_null_graph(nodes, 0)
