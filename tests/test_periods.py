"""Graph steps of whole periods against the steps on edge tables."""

import numpy as np
import pytest

from tessera.operators import diagnostics, graph, neighbours, periods
from tessera.plans import jobs


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    rows = [(t, i, *map(float, rng.normal(size=2)), float(rng.normal())) for t in range(9) for i in range(-3, 25) if rng.random() < 0.9]
    panel = spark.createDataFrame([(t, i, None if i == 5 else a, b, y) for t, i, a, b, y in rows], "t int, id long, f1 double, f2 double, y double").repartition(3).cache()
    # ends without a node, loops, one direction and both, a period without edges, a node without any
    drawn = {(int(rng.integers(0, 8)), int(rng.integers(-3, 30)), int(rng.integers(-3, 24))) for _ in range(400)}
    edges = spark.createDataFrame([(*e, float(rng.random())) for e in sorted(drawn)], "t int, src long, dst long, w double").repartition(3).cache()
    return panel, edges


@pytest.mark.parametrize("finish", [{}, {"self_loop": True, "gcn_norm": True}, {"symmetric": False}, {"symmetric": False, "row_norm": False, "self_loop": True}])
def test_hops_of_whole_periods(small, finish):
    panel, edges = small
    want = neighbours.graph_features(panel, graph.finished(edges, graph.nodes_of(panel), **finish), ["f1", "f2"], 2).orderBy("t", "id").toPandas()
    got = neighbours.graph_features(panel, edges, ["f1", "f2"], 2, finish=finish).orderBy("t", "id").toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == panel.count()
    assert np.allclose(got, want, equal_nan=True)


def test_jobs_finish_no_edge_table_where_periods_fit(small, monkeypatch):
    panel = small[0].na.fill(0.0)
    want = jobs.sweep_k(panel, ["f1", "f2"], [2, 4]).orderBy("k_neighbors").toPandas()
    with monkeypatch.context() as m:
        m.setattr(periods, "EDGES", 0)
        other = jobs.sweep_k(panel, ["f1", "f2"], [2, 4]).orderBy("k_neighbors").toPandas()
    assert np.allclose(want, other)

    def never(*args, **more):
        raise AssertionError("edges are moved again")

    monkeypatch.setattr(graph, "finished", never)
    assert np.allclose(jobs.sweep_k(panel, ["f1", "f2"], [2, 4]).orderBy("k_neighbors").toPandas(), want)


def test_neighbours_factors_of_whole_periods(small, monkeypatch):
    panel, edges = small
    tables = []
    for most in (periods.EDGES, 0):
        monkeypatch.setattr(periods, "EDGES", most)
        both = diagnostics.with_neighbours(panel, edges, ["f1", "f2"], finish={})
        tables.append(both.orderBy("t", "id").toPandas())
    assert list(tables[0].columns) == list(tables[1].columns) and np.allclose(*tables, equal_nan=True)
    want = diagnostics.incremental_r2(panel, graph.symmetrize(edges), ["f1", "f2"]).orderBy("t").toPandas()
    assert np.allclose(diagnostics.r2_by_neighbours(both, ["f1", "f2"]).orderBy("t").toPandas()["delta_r2"], want["delta_r2"], equal_nan=True)


@pytest.mark.parametrize("symmetric", [True, False])
def test_diagnostics_of_whole_periods(small, monkeypatch, symmetric):
    panel = small[0].na.fill(0.0)
    edges = small[1].where("src <> dst")
    want = diagnostics.diagnostics_summary(panel, graph.symmetrize(edges) if symmetric else edges, ["f1", "f2"], "s").toPandas()
    got = diagnostics.diagnostics_summary(panel, edges, ["f1", "f2"], "s", symmetric=symmetric).toPandas()
    assert np.allclose(got.drop(columns="scenario"), want.drop(columns="scenario"))
