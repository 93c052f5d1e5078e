"""Hand fixtures with known answers for the panel, graph and portfolio operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import compare, diagnostics, graph, knn, metrics, neighbours, panel, portfolio, regress


def panel_of(spark, values, name="f"):
    return spark.createDataFrame([(0, i, None if v is None else float(v)) for i, v in enumerate(values)], f"t int, id long, {name} double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ["id"])).collect()]


def edges_of(spark, rows):
    return spark.createDataFrame([(0, a, b, float(w)) for a, b, w in rows], "t int, src long, dst long, w double")


def as_dict(edges):
    return {(r.src, r.dst): r.w for r in edges.collect()}


@pytest.fixture(scope="module")
def path4(spark):
    return edges_of(spark, [(a, b, 1) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2))])


def test_cleaning(spark):
    assert column(panel.zscore_cs(panel_of(spark, [1, 2, 3]), ["f"]), "f") == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert column(panel.zscore_cs(panel_of(spark, [7, 7, 7]), ["f"]), "f") == [0, 0, 0]
    w = column(panel.winsorize_cs(panel_of(spark, [1, 2, 3, 4, 5]), ["f"]), "f")
    assert (min(w), max(w)) == pytest.approx((1.04, 4.96))
    top = 1.7976931348623157e308
    assert column(panel.fillna_zero(panel_of(spark, [math.nan, None, math.inf, -math.inf, 2]), ["f"]), "f") == [0, 0, top, -top, 2]
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, math.nan), (1, 0, 3.0), (1, 1, None)], "t int, id long, f double")
    assert column(panel.fillna_mean(df, ["f"]), "f", "t", "id") == [1, 2, 3, 2]


def test_alignment_and_split(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 10.0), (1, 1, 2.0, 20.0), (2, 1, 3.0, 30.0), (0, 2, 4.0, 40.0), (2, 2, 5.0, 50.0)], "t int, id long, f double, y double")
    assert sorted((r.id, r.t, r.y) for r in panel.align_target(df, ["f"]).collect()) == [(1, 0, 20.0), (1, 1, 30.0)]
    assert panel.split_points(119, 0.6, 0.2, 0.2) == (71, 95) and panel.split_points(83, 0.6, 0.2, 0.2) == (49, 66)
    with pytest.raises(ValueError):
        panel.split_points(10, 0.7, 0.1, 0.2)
    with pytest.raises(ValueError):
        panel.align_target(df, ["f"], 0)


@pytest.mark.parametrize("path", ["sql", "block"])
def test_knn(spark, path):
    p = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 3, 3.0)], "t int, id long, f double")
    edges = knn.rbf_edges(knn.knn_topk(p, ["f"], 1, path=path, block=2), 1.0)
    assert as_dict(edges) == pytest.approx({(0, 1): math.exp(-1), (1, 0): math.exp(-1), (3, 1): math.exp(-4)})
    sym = graph.symmetrize(edges)
    assert as_dict(sym)[(1, 3)] == pytest.approx(0.00915782)
    rows = as_dict(graph.row_normalize(sym))
    assert rows[(1, 0)] == pytest.approx(0.9757111) and rows[(0, 1)] == pytest.approx(1)
    gcn = as_dict(graph.gcn_normalize(graph.add_self_loops(sym, p.select("t", "id"))))
    assert [gcn[k] for k in ((0, 0), (1, 1), (3, 3), (0, 1), (1, 3))] == pytest.approx([0.73105858, 0.72619676, 0.99092529, 0.26804565, 0.00776855])
    twins = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (0, 2, 9.0)], "t int, id long, f double")
    assert set(as_dict(knn.rbf_edges(knn.knn_topk(twins, ["f"], 1, path=path), 1.0))) == {(2, 0)}
    far = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 1, -1.0, 0.0)], "t int, id long, a double, b double")
    assert knn.factor_cosine_graph(far, ["a", "b"], 1, path=path).count() == 0


def test_knn_paths_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(t, i, *map(float, np.round(rng.normal(size=3), 1))) for t in range(3) for i in range(60)]
    p = spark.createDataFrame(rows, "t int, id long, a double, b double, c double")
    found = [{(r.t, r.src, r.dst, r["rank"]) for r in knn.knn_topk(p, ["a", "b", "c"], 5, path=how, block=16).collect()} for how in ("sql", "block")]
    assert found[0] == found[1] and len(found[0]) == 900


def test_graph_algebra(spark, path4):
    one_way = edges_of(spark, [(0, 1, -2)])
    assert graph.symmetrize(one_way, "max").count() == 0 and as_dict(graph.symmetrize(one_way)) == {(0, 1): -1, (1, 0): -1}
    lone = panel_of(spark, [0, 0, 0, 0, 0])
    lap = as_dict(graph.laplacian(path4, lone.select("t", "id")))
    assert lap[(4, 4)] == 1 and lap[(0, 0)] == 1
    assert column(graph.degree(path4, lone.select("t", "id")), "d") == [1, 2, 2, 1, 0]


def test_neighbours_and_gcn(spark, path4):
    x = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 1, 0.0, 1.0), (0, 2, 1.0, 1.0), (0, 3, 2.0, 0.0)], "t int, id long, a double, b double")
    e = graph.row_normalize(path4)
    near = neighbours.neighbor_features(x, e, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in near] == [(0, 1), (1, 0.5), (1, 0.5), (1, 1)]
    hidden = neighbours.gcn_features(x, e, ["a", "b"], [[1, -1], [0, 1]], [0, 0.5]).orderBy("id").collect()
    assert [(r.g0, r.g1) for r in hidden] == [(0, 1.5), (1, 0), (1, 0), (1, 0.5)]
    out = neighbours.gcn_predict(x, e, ["a", "b"], [([[1, -1], [0, 1]], [0, 0.5]), ([[1], [2]], [-1])])
    assert column(out, "y_pred") == [0, 1, 0.5, 0]


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 1.0, 2.0), (1.0, 1.0, 3.0), (2.0, 1.0, 5.0), (1.0, 3.0, 6.0)], "a double, b double, y double")
    b0, b = regress.fit_ridge(df, ["a", "b"], 1.0)
    assert (b0, *b) == pytest.approx((0.82758621, 1.0, 1.31034483))
    b0, b = regress.fit_ols(df, ["a", "b"])
    assert (b0, *b) == pytest.approx((0, 1.5, 1.58333333), abs=1e-8)


def preds(spark, true, score):
    return spark.createDataFrame([("m", 0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(true, score))], "model string, t int, id long, y_true double, y_pred double")


def test_metrics_and_portfolios(spark):
    assert column(metrics.with_average_rank(preds(spark, [0] * 4, [10, 20, 20, 30]), "y_pred", "r", ["model", "t"]), "r") == [1, 2.5, 2.5, 4]
    assert metrics.ic(preds(spark, [1, 2, 3], [5, 5, 5])).first().ic == 0
    for n, bins, sizes in ((10, 4, [3, 2, 3, 2]), (7, 5, [2, 1, 2, 1, 1]), (11, 4, [3, 3, 3, 2])):
        got = portfolio.quantile_bins(preds(spark, range(n), range(n)), bins).groupBy("bin").count().orderBy("bin").collect()
        assert [r["count"] for r in got] == sizes
    assert portfolio.long_short(preds(spark, [1, 5, 9], [3, 2, 1])).first().ls == -8
    series = spark.createDataFrame([("m", 0, 0.1), ("m", 1, -0.5), ("m", 2, 0.2)], "model string, t int, ls double")
    assert portfolio.sharpe(series).first().ls_sharpe == pytest.approx(-0.21566555)
    assert portfolio.sharpe(series, periods=12).first().ls_sharpe == pytest.approx(-0.74708737)
    assert column(portfolio.cumulative_returns(series), "cum", "t") == pytest.approx([0.1, -0.45, -0.34])


def test_diagnostics(spark, path4):
    y = panel_of(spark, [1, 2, 3, 4], "y")
    assert diagnostics.morans_i(y, path4).first().moran_i == pytest.approx(1 / 3)
    assert diagnostics.dirichlet_energy(y, path4, normalized=False).first().dirichlet_energy == pytest.approx(3.0)
    assert diagnostics.dirichlet_energy(y, path4).first().dirichlet_energy == pytest.approx(4.20101013)
    assert diagnostics.neighbor_residual_corr(y, path4, "y").first().residual_corr == pytest.approx(0.89442719)
    six = edges_of(spark, [e for a in range(5) for e in ((a, a + 1, 1), (a + 1, a, 1))])
    df = spark.createDataFrame([(0, i, float(i + 1), float(v)) for i, v in enumerate([1, 2, 4, 3, 7, 5])], "t int, id long, x double, y double")
    r = diagnostics.incremental_r2(df, six, ["x"]).first()
    assert (r.r2_base, r.r2_full, r.delta_r2) == pytest.approx((0.70775510, 0.76285714, 0.05510204))


def test_model_delta(spark):
    table = spark.createDataFrame([("a", 0.03), ("b", 0.05)], "model string, r2 double")
    assert compare.model_delta(table, "a", "b").first().r2 == pytest.approx(0.02)
    with pytest.raises(ValueError):
        compare.model_delta(table, "a", "c")


def test_plan_has_no_python_rows(spark, sf):
    from tessera.plans.registry import QUERIES

    plan = QUERIES["evaluate_portfolio"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert F is not None


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
