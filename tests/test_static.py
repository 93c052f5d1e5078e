"""One graph for all periods against the graph copied to every period."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours

FACTORS = ["a.b", "f2"]


@pytest.fixture(scope="module")
def data(spark):
    """An unbalanced panel, some values missing, ids of any size, a hub, edges to absent entities."""
    rng = np.random.default_rng(1)
    ids = [-(2**62), -3, 0, 5, 7, 11, 2**62, 100, 101, 102]
    rows = [(t, i, *map(float, rng.normal(size=2))) for t in range(6) for i in ids if rng.random() < 0.8]
    rows[3] = (*rows[3][:2], None, 1.0)
    panel = spark.createDataFrame(rows, "t int, id long, `a.b` double, f2 double").repartition(3)
    pairs = {(i, j) for i in ids for j in rng.choice(len(ids), 3) for j in [ids[j]]} | {(5, j) for j in ids} | {(7, 999), (998, 7)}
    edges = spark.createDataFrame([(i, j, float(rng.random())) for i, j in sorted(pairs) if i != 102], "src long, dst long, w double").repartition(4)
    return panel, edges


def rows(df):
    return {(r["t"], r["id"]): tuple(r[c] for c in df.columns[2:]) for r in df.collect()}


def same(a, b):
    a, b = rows(a), rows(b)
    assert a.keys() == b.keys() and len(a) > 0
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_static_hops_equal_the_copied_graph(data):
    panel, edges = data
    plain = panel.withColumnsRenamed({"a.b": "f1"})
    copied = edges.crossJoin(plain.select("t").distinct())
    for k, (got, want) in enumerate(zip(neighbours.propagate_hops(plain, edges, ["f1", "f2"], 3), neighbours.propagate_hops(plain, copied, ["f1", "f2"], 3), strict=True), 1):
        assert got.columns == ["t", "id", f"f1_h{k}", f"f2_h{k}"]
        same(got, want)
    full = plain.fillna(0.0)
    same(neighbours.graph_features(full, edges, ["f1", "f2"], 2), neighbours.graph_features(full, copied, ["f1", "f2"], 2))
    same(neighbours.spillover_score(full, edges, ["f1", "f2"], [1.0, 2.0], [0.5, -1.0], 0.7), neighbours.spillover_score(full, copied, ["f1", "f2"], [1.0, 2.0], [0.5, -1.0], 0.7))


def test_edges_are_shuffled_once(spark, data):
    panel, edges = data
    last = neighbours.propagate_hops(panel.withColumnsRenamed({"a.b": "f1"}), edges.where(F.col("w") > -1), ["f1", "f2"], 3)[-1]
    last.collect()
    plan = last._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    read = [x for x in plan.split("\n") if "Scan ExistingRDD[src" in x]
    assert len(read) == 1 and plan.count("ReusedExchange") >= 2, "the edges are read and dealt once; later hops reuse them"


def test_no_edges_and_no_rows(spark, data):
    panel, edges = data
    plain = panel.withColumnsRenamed({"a.b": "f1"})
    none = neighbours.neighbor_features(plain, edges.where("w > 9"), ["f1"])
    assert {r["f1"] for r in none.collect()} == {0.0} and none.count() == plain.count()
    assert neighbours.neighbor_features(plain.where("t > 99"), edges, ["f1"]).count() == 0
