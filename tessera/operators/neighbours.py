"""Neighbour aggregation over edge tables, and graph convolutions built on it.

Edges without a column ``t`` are one graph for all periods (``static``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import stored
from tessera.operators import graph, periods, static


def _periods(panel: DataFrame) -> int:
    last = panel.agg(F.max("t").alias("t")).first()["t"]
    return 1 if last is None else last + 1


def neighbor_features(panel: DataFrame, edges: DataFrame, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """(t, id, ...): the weighted sum of the neighbours' columns; 0 for nodes without edges."""
    names = names or columns
    if "t" not in edges.columns:
        return static.rows_of(static.hops_of(panel, edges, columns, 1, _periods(panel))[0], names)
    far = panel.select("t", F.col("id").alias("dst"), *columns)
    sums = edges.join(far, ["t", "dst"]).groupBy("t", F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(n) for c, n in zip(columns, names, strict=True)])
    nodes = panel.select("t", "id")
    return nodes.join(sums, ["t", "id"], "left").select("t", "id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def propagate_hops(panel: DataFrame, edges: DataFrame, factors: list[str], hops: int = 2) -> list[DataFrame]:
    """One table for each hop, columns ``f_h1``, ``f_h2``, ..."""
    if hops < 1:
        raise ValueError("hops must be at least 1")
    if "t" not in edges.columns:
        found = static.hops_of(panel, edges, factors, hops, _periods(panel))
        return [static.rows_of(v, [f"{f}_h{h}" for f in factors]) for h, v in enumerate(found, 1)]
    out, columns, current = [], factors, panel
    for h in range(1, hops + 1):
        names = [f"{f}_h{h}" for f in factors]
        current = neighbor_features(current, edges, columns, names)
        out.append(current)
        columns = names
    return out


def graph_features(panel: DataFrame, edges: DataFrame, factors: list[str], hops: int = 1, include_self: bool = True, finish: dict | None = None) -> DataFrame:
    """Own factors first, then each hop's.

    With ``finish`` (switches of ``graph.finished``) the edges come unfinished; what fits is finished and aggregated a period at a time (``periods``).
    """
    if finish is not None:
        if periods.fit(panel, edges):
            return periods.hops(panel, edges, factors, hops, lambda c, h: f"{c}_h{h}", factors if include_self else [], **finish)
        edges = stored(graph.finished(edges, graph.nodes_of(panel), **finish), "finished")
    out = panel.select("t", "id", *(factors if include_self else []))
    for hop in propagate_hops(panel, edges, factors, hops):
        out = out.join(hop, ["t", "id"])
    return out


def dot(columns: list[str], beta: list[float]) -> Column:
    if len(columns) != len(beta):
        raise ValueError("as many coefficients as factors are needed")
    return sum((F.col(c) * float(b) for c, b in zip(columns[1:], beta[1:], strict=True)), F.col(columns[0]) * float(beta[0]))


def self_score(panel: DataFrame, factors: list[str], beta: list[float]) -> DataFrame:
    return panel.select("t", "id", dot(factors, beta).alias("score"))


def spillover_score(panel: DataFrame, edges: DataFrame, factors: list[str], beta_self: list[float], beta_neighbor: list[float], gamma: float) -> DataFrame:
    """x . beta_self + gamma * A (x . beta_neighbor): one column is shuffled, not one for each factor."""
    own = panel.select("t", "id", dot(factors, beta_self).alias("own"), dot(factors, beta_neighbor).alias("exposure"))
    spread = neighbor_features(own, edges, ["exposure"], ["spread"])
    return own.join(spread, ["t", "id"]).select("t", "id", (F.col("own") + gamma * F.col("spread")).alias("score"))


def hidden_score(panel: DataFrame, signal: DataFrame, factors: list[str], beta: list[float], delta: float = 1.0) -> DataFrame:
    """x . beta + delta * h, with h from its own table (t, id, h)."""
    joined = panel.select("t", "id", dot(factors, beta).alias("own")).join(signal, ["t", "id"])
    return joined.select("t", "id", (F.col("own") + delta * F.col("h")).alias("score"))


def gcn_layer(panel: DataFrame, edges: DataFrame, columns: list[str], weights: list[list[float]], bias: list[float], relu: bool, prefix: str) -> DataFrame:
    """A (H W) + b: the projection comes before the join, which then carries as few columns as it can."""
    names = [f"{prefix}{j}" for j in range(len(bias))]
    projected = panel.select("t", "id", *[dot(columns, [row[j] for row in weights]).alias(n) for j, n in enumerate(names)])
    out = neighbor_features(projected, edges, names)
    shifted = {n: F.col(n) + float(b) for n, b in zip(names, bias, strict=True)}
    return out.withColumns({n: F.greatest(c, F.lit(0.0)) if relu else c for n, c in shifted.items()})


def gcn_features(panel: DataFrame, edges: DataFrame, factors: list[str], weights: list[list[float]], bias: list[float]) -> DataFrame:
    return gcn_layer(panel, edges, factors, weights, bias, True, "g")


def gcn_predict(panel: DataFrame, edges: DataFrame, factors: list[str], layers: list[tuple[list[list[float]], list[float]]]) -> DataFrame:
    """ReLU layers, the last one linear with one output per node (t, id, y_pred)."""
    columns, current = factors, panel
    for i, (weights, bias) in enumerate(layers):
        current = gcn_layer(current, edges, columns, weights, bias, i < len(layers) - 1, f"l{i}_")
        columns = [f"l{i}_{j}" for j in range(len(bias))]
    return current.select("t", "id", F.col(columns[0]).alias("y_pred"))
