"""Quantiles by selection against numpy and Spark's own aggregate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import panel as panels
from tessera.operators import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.fixture(scope="module")
def panel(spark):
    """Periods of 0 to 3,000 values: tiny, huge, negative, both zeros, missing; one value in a third of the rows."""
    rng = np.random.default_rng(5)
    rows = []
    for t, n in [(0, 1), (1, 2), (2, 3), (5, 3000), (-3, 41)]:
        for i in range(n):
            x = 1.25 if rng.random() < 0.3 else float(rng.normal() * 10.0 ** rng.integers(-200, 200))
            rows.append((t, i, x, [0.0, -0.0, -5e-324, 5e-324][i % 4], float("nan") if rng.random() < 0.2 else float(rng.integers(-3, 3)), None))
    rows += [(7, 0, None, None, None, None), (None, 1, 5.0, 5.0, 5.0, 5.0)]
    return spark.createDataFrame(rows, "t int, id long, wide double, zeros double, few double, none double").withColumnRenamed("few", "a.b").repartition(5)


def test_image_keeps_order():
    x = np.array([-math.inf, -1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.7e308, math.inf])
    u = quantiles.image(x)
    assert (np.sort(u) == u).all() and len(set(u.tolist())) == len(x) - 1
    assert quantiles.preimage(u).tolist() == x.tolist()


def test_equal_to_sorting(panel):
    plain = panel.withColumnRenamed("a.b", "few")
    got = {r["t"]: r for r in quantiles.exact_quantiles(plain, ["wide", "zeros", "few", "none"], SHARES).collect()}
    assert set(got) == {0, 1, 2, 5, -3, 7}
    every = plain.where("t IS NOT NULL").toPandas()
    for t, rows in every.groupby("t"):
        for c in ("wide", "zeros", "few", "none"):
            x = np.sort(rows[c].astype(float).dropna().to_numpy())
            if not len(x):
                assert got[t][c] is None
                continue
            for q, value in zip(SHARES, got[t][c]):
                at = q * (len(x) - 1)
                low, high = x[math.floor(at)], x[math.ceil(at)]
                assert value == (low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high), (t, c, q)


def test_equal_to_the_aggregate(panel):
    want = panel.where("t IS NOT NULL").groupBy("t").agg(F.expr("percentile(wide, array(0.01D, 0.99D))").alias("wide")).collect()
    got = quantiles.exact_quantiles(panel, ["wide"], [0.01, 0.99]).collect()
    assert {r["t"]: r["wide"] for r in got} == {r["t"]: r["wide"] for r in want}


def test_counts_are_handed_on_in_parts(panel, monkeypatch):
    whole = quantiles.exact_quantiles(panel, ["wide"], [0.37]).collect()
    monkeypatch.setattr(quantiles, "_HELD", 1)
    assert sorted(quantiles.exact_quantiles(panel, ["wide"], [0.37]).collect()) == sorted(whole)


def test_winsorize_by_selection(panel):
    plain = panel.withColumnRenamed("a.b", "few").where("t IS NOT NULL").select("t", "id", "wide", "zeros", "few")
    key = lambda r: (r["t"], r["id"])
    a, b = (sorted(panels.winsorize_cs(plain, ["wide", "zeros"], 0.05, 0.9, path=p).collect(), key=key) for p in ("select", "sort"))
    assert [(*r,)[:4] for r in a] == [(*r,)[:4] for r in b] and len(a) == plain.count()


def test_nothing_and_errors(panel):
    assert quantiles.exact_quantiles(panel.where("false"), ["wide"], [0.5]).collect() == []
    assert quantiles.exact_quantiles(panel.where("t = 7"), ["wide"], [0.5]).collect() == [(7, None)]
    for columns, shares in ((["wide"], []), (["wide"], [1.5]), (["wide", "wide"], [0.5]), (["t"], [0.5])):
        with pytest.raises(ValueError):
            quantiles.exact_quantiles(panel, columns, shares)
    with pytest.raises(ValueError):
        panels.winsorize_cs(panel, ["wide"], path="other")
