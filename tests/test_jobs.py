"""Jobs against numpy versions written from the definitions, on a small panel."""

import numpy as np
import pytest

from tessera.operators import compare, diagnostics, graph, knn, panel
from tessera.plans import jobs

FACTORS = ["f1", "f2", "f3"]
T, N = 14, 24


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(T, N, 3))
    y = 0.3 * np.roll(x[:, :, 0], 1, axis=0) + rng.normal(size=(T, N)) * 0.5
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    rows = [(t, i, *map(float, x[t, i]), float(y[t, i])) for t in range(T) for i in range(N)]
    return spark.createDataFrame(rows, "t int, id long, f1 double, f2 double, f3 double, y double").repartition(3).cache()


def adjacency(x, k, gcn=True):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    a = np.zeros_like(d)
    for i in range(len(x)):
        near = np.argsort(d[i], kind="stable")[:k]
        a[i, near] = np.exp(-d[i, near])
    a = (a + a.T) / 2
    if not gcn:
        return a
    a += np.eye(len(x))
    s = a.sum(1)
    return a / np.sqrt(s[:, None] * s[None, :])


def ridge(x, y, alpha):
    x1 = np.hstack([np.ones((len(x), 1)), x])
    return np.linalg.solve(x1.T @ x1 + alpha * np.diag([0.0] + [1.0] * x.shape[1]), x1.T @ y)


def scored(designs, y, alpha=1.0):
    """Predictions on the test periods by a ridge on the training ones; designs (T - 1, N, k), y of the next period."""
    total = T - 1
    first, second = int(total * 0.6), int(total * 0.8)
    k = designs.shape[-1]
    beta = ridge(designs[:first].reshape(-1, k), y[1 : first + 1].ravel(), alpha)
    return [beta[0] + d @ beta[1:] for d in designs[second:]], y[second + 1 :], [beta[0] + d @ beta[1:] for d in designs[first:second]], y[first + 1 : second + 1]


def r2_ic(pred, true):
    p, t = np.array(pred), np.array(true)
    return 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum(), np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(p, t, strict=True)])


def test_sweep_k(table, data):
    x, y = data
    got = {r.k_neighbors: r for r in jobs.sweep_k(table, FACTORS, [2, 5]).collect()}
    raw = r2_ic(*scored(x[:-1], y)[:2])
    for k in (2, 5):
        a = [adjacency(x[t], k) for t in range(T)]
        both = np.stack([np.hstack([x[t], a[t] @ x[t]]) for t in range(T - 1)])
        want = r2_ic(*scored(both, y)[:2])
        r = got[k]
        assert (r.raw_r2, r.raw_mean_ic, r.graph_r2, r.graph_mean_ic) == pytest.approx((*raw, *want))
        assert (r.delta_r2, r.delta_ic) == pytest.approx((want[0] - raw[0], want[1] - raw[1]))


def test_experiment(table, data):
    x, y = data
    edges = knn.factor_knn_graph(table, FACTORS, 4, self_loop=True, gcn_norm=True)
    got = {r.model: r for r in compare.model_summary(jobs.experiment(table, edges, FACTORS)).collect()}
    a = [adjacency(x[t], 4) for t in range(T)]
    hop1 = np.stack([a[t] @ x[t] for t in range(T - 1)])
    hop2 = np.stack([a[t] @ hop1[t] for t in range(T - 1)])
    designs = {"raw": [(x[:-1], 1.0)], "graph": [(np.concatenate([x[:-1], hop1], axis=-1), 1.0)], "sgc": [(h, al) for h in (hop1, hop2) for al in jobs.SGC_ALPHAS]}
    names = [n for n in got if n not in designs]
    assert len(names) == 1 and names[0].startswith("sgc") or set(got) == set(designs)
    for name, tried in designs.items():
        runs = [scored(d, y, al) for d, al in tried]
        losses = [np.mean([((p - t) ** 2).mean() for p, t in zip(r[2], r[3], strict=True)]) for r in runs]
        want = r2_ic(*runs[int(np.argmin(losses))][:2])
        r = got[name]
        assert (r.r2, r.mean_ic) == pytest.approx(want)


def test_diagnostics_summary(spark, table, data):
    x, y = data
    edges = knn.factor_knn_graph(table, FACTORS, 4, row_norm=False)
    r = diagnostics.diagnostics_summary(table, edges, FACTORS, "s").first()
    rows = []
    for t in range(T):
        a = adjacency(x[t], 4, gcn=False)
        s = a.sum(1)
        z = y[t] - y[t].mean()
        moran = N / a.sum() * (z @ a @ z) / (z @ z)
        energy = y[t] @ y[t] - y[t] @ (a / np.sqrt(s[:, None] * s[None, :])) @ y[t]
        row = a / s[:, None]
        fit = lambda d: y[t] - d @ np.linalg.lstsq(d, y[t], rcond=None)[0]  # noqa: E731, B023
        one = np.hstack([np.ones((N, 1)), x[t]])
        e = fit(one)
        full = fit(np.hstack([one, row @ x[t]]))
        rows.append((moran, energy, np.corrcoef(e, row @ e)[0, 1], (e @ e - full @ full) / (z @ z)))
    assert (r.moran_i, r.dirichlet_energy, r.residual_corr, r.delta_r2) == pytest.approx(tuple(np.mean(rows, axis=0)))
    bare = diagnostics.incremental_r2(table, edges, FACTORS, intercept=False).orderBy("t").first()
    d = x[0]
    e = y[0] - d @ np.linalg.lstsq(d, y[0], rcond=None)[0]
    z = y[0] - y[0].mean()
    assert bare.r2_base == pytest.approx(1 - e @ e / (z @ z)) and bare.beta_full[0] == 0


def test_placebo_and_checks(spark, table):
    null = knn.random_null_graph(graph.nodes_of(table), 5)
    rows = null.collect()
    assert len(rows) == T * N * 5 == len({(r.t, r.src, r.dst) for r in rows}) and {r.w for r in rows} == {1.0}
    assert knn.random_null_graph(graph.nodes_of(table), 30).count() == T * N * N
    with pytest.raises(Exception, match="below the number"):
        knn.knn_topk(table, FACTORS, N).collect()
    from tessera.operators import portfolio

    pred = table.selectExpr("'m' AS model", "t", "id", "y AS y_true", "f1 AS y_pred")
    with pytest.raises(Exception, match="fewer rows than bins"):
        portfolio.quantile_bins(pred, N + 1).collect()


def test_flat_dataset(table, data):
    x, y = data
    rows = panel.raw_dataset(table, FACTORS).orderBy("row").collect()
    assert [r.row for r in rows] == list(range((T - 1) * N))
    assert [r.f1 for r in rows] == x[:-1, :, 0].ravel().tolist() and [r.y for r in rows] == y[1:].ravel().tolist()
    assert panel.raw_dataset(table, FACTORS, flatten=False).columns == ["t", "id", *FACTORS, "y"]
