"""Whole jobs: experiments and parameter sweeps over a panel (t, id, factors, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import stored
from tessera.operators import compare, graph, knn, metrics, neighbours, panel, periods, regress

#: Ridge penalties and hops among which the graph convolution is chosen on the validation part.
SGC_HOPS, SGC_ALPHAS = (1, 2), (0.1, 10.0)


def _split(wide: DataFrame, columns: list[str], total: int) -> DataFrame:
    return panel.time_split(panel.align_target(wide, columns), total)


def _scored(rows: DataFrame, models: dict[str, tuple[list[str], tuple[float, list[float]]]], keys: list[str]) -> DataFrame:
    """``keys``, model, y_true, y_pred: all models' predictions from one scan."""
    each = [F.struct(F.lit(name).alias("model"), (neighbours.dot(columns, coef[1]) + coef[0]).alias("y_pred")) for name, (columns, coef) in models.items()]
    return rows.select(*keys, F.col("y").alias("y_true"), F.explode(F.array(*each)).alias("m")).select("m.model", *keys, "y_true", "m.y_pred")


def experiment(cleaned: DataFrame, edges: DataFrame, factors: list[str], alpha: float = 1.0, finish: dict | None = None) -> DataFrame:
    """Predictions (model, t, id, y_true, y_pred) of the test part by three models.

    ``raw``: ridge on the factors; ``graph``: ridge on the factors and their neighbours';
    ``sgc``: linear graph convolution, its hops and penalty chosen on the validation part.
    All fits come from one aggregation, all predictions from one scan. With ``finish`` the edges come unfinished (``neighbours.graph_features``).
    """
    hop = [[f"{f}_h{h}" for f in factors] for h in (1, 2)]
    features = neighbours.graph_features(cleaned, edges, factors, 2, finish=finish)
    # the later outcome is a narrow table; the wide one is joined once
    later = cleaned.select((F.col("t") - 1).alias("t"), "id", "y")
    data = stored(panel.time_split(features.join(later, ["t", "id"]), panel.periods(cleaned) - 1), "experiment")
    sums = regress.moments(data.where("part = 'train'"), [*factors, *hop[0], *hop[1]])
    tried = {f"sgc hops={h} alpha={a}": (hop[h - 1], regress.solve_ridge(sums, hop[h - 1], a)) for h in SGC_HOPS for a in SGC_ALPHAS}
    best = regress.select_on_validation(regress.panel_loss(_scored(data.where("part = 'valid'"), tried, ["t", "id"])))
    models = {"raw": (factors, regress.solve_ridge(sums, factors, alpha)), "graph": ([*factors, *hop[0]], regress.solve_ridge(sums, [*factors, *hop[0]], alpha))}
    if best is not None:
        models["sgc"] = tried[best]
    return stored(_scored(data.where("part = 'test'"), models, ["t", "id"]), "predictions")


def convolution(cleaned: DataFrame, edges: DataFrame, factors: list[str]) -> DataFrame:
    """Predictions (model, t, id, y_true, y_pred) of the test part by the linear graph convolution alone.

    Its hops and penalty are chosen on the validation part; without a validation part there is no row.
    The hops are computed once; all fits come from one aggregation over them.
    """
    hop = [[f"{f}_h{h}" for f in factors] for h in SGC_HOPS]
    wide = cleaned.select("t", "id", "y")
    for table in neighbours.propagate_hops(cleaned, edges, factors, max(SGC_HOPS)):
        wide = wide.join(table, ["t", "id"])
    data = stored(_split(wide, [c for names in hop for c in names], panel.periods(cleaned) - 1), "convolution")
    sums = regress.moments(data.where("part = 'train'"), [c for names in hop for c in names])
    tried = {f"hops={h} alpha={a}": (names, regress.solve_ridge(sums, names, a)) for h, names in zip(SGC_HOPS, hop, strict=True) for a in SGC_ALPHAS}
    best = regress.select_on_validation(regress.panel_loss(_scored(data.where("part = 'valid'"), tried, ["t", "id"])))
    return _scored(data.where("part = 'test'"), {best: tried[best]} if best else tried, ["t", "id"]).where(F.lit(best is not None))


def run_experiment(cleaned: DataFrame, edges: DataFrame, factors: list[str], scenario: str, finish: dict | None = None) -> DataFrame:
    """One row a model for one scenario: which outcome (``y``) and which graph are passed in."""
    return compare.model_summary(experiment(cleaned, edges, factors, finish=finish)).select(F.lit(scenario).alias("scenario"), "*")


def _compared(scores: DataFrame, key: str) -> DataFrame:
    """(key, raw_r2, graph_r2, raw_mean_ic, graph_mean_ic, delta_r2, delta_ic) from predictions with a column ``key``."""
    named = scores.withColumn("model", F.concat_ws(" ", F.col(key).cast("string"), "model"))
    table = metrics.pooled_errors(named).join(metrics.ic_ir(metrics.ic(named), "ic"), "model")
    parts = F.split("model", " ")
    wide = table.select(parts[0].alias(key), parts[1].alias("kind"), "r2", "mean_ic").groupBy(key).pivot("kind", ["raw", "graph"]).agg(F.first("r2").alias("r2"), F.first("mean_ic").alias("mean_ic"))
    return wide.select(
        F.col(key).cast(scores.schema[key].dataType).alias(key), "raw_r2", "graph_r2", "raw_mean_ic", "graph_mean_ic",
        (F.col("graph_r2") - F.col("raw_r2")).alias("delta_r2"), (F.col("graph_mean_ic") - F.col("raw_mean_ic")).alias("delta_ic"),
    )


def sweep_k(cleaned: DataFrame, factors: list[str], ks: list[int], tau: float = 1.0, alpha: float = 1.0) -> DataFrame:
    """Raw and graph R2 and mean IC, and their differences, for each number of neighbours.

    One neighbour pass at the largest k. All graphs of a period come from its ranked neighbours in one task
    where they fit; else the grid is part of the period's number, so that every graph step runs once for all of it.
    """
    total, n = panel.periods(cleaned), len(ks)
    near = stored(knn.rbf_edges(knn.knn_topk(cleaned, factors, max(ks), short="all"), tau, keep_rank=True), "neighbours")
    names = [f"{f}_h1" for f in factors]
    finish = {"self_loop": True, "gcn_norm": True}
    if periods.fit(cleaned, near):
        known = panel.align_target(cleaned, factors).select("t", "id", "y", F.lit(1).alias("_later"))
        nodes = cleaned.select("t", "id", *factors).join(known, ["t", "id"], "left")
        wide = periods.hops(nodes, near, factors, 1, lambda c, h: f"{c}_h{h}", [*factors, "y", "_later"], ks, **finish)
        data = wide.where(F.col("_later") == 1).select("t", "g", "id", *factors, *names, "y")
    else:
        grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(ks)]))
        period = F.col("g.i") * total + F.col("t")
        edges = near.withColumn("g", grid).where(F.col("rank") <= F.col("g.k")).select(period.alias("t"), "src", "dst", "w")
        copies = cleaned.withColumn("g", grid).select(period.alias("t"), "id", *factors, "y")
        edges = graph.finished(edges, copies.select("t", "id"), **finish)
        wide = neighbours.neighbor_features(copies, edges, factors, names).join(copies, ["t", "id"])
        wide = wide.select((F.col("t") % total).cast("int").alias("t"), F.expr(f"cast(t div {total} as int)").alias("g"), "id", *factors, *names, "y")
        later = wide.select((F.col("t") - 1).alias("t"), "g", "id", F.col("y").alias("_y"))
        data = wide.drop("y").join(later, ["t", "g", "id"]).withColumnRenamed("_y", "y")
    data = stored(panel.time_split(data, total - 1), "sweep")
    sums = regress.moments_by(data.where("part = 'train'"), "g", [*factors, *names])
    test, out = data.where("part = 'test'"), None
    for i in range(n):  # a filter on one stored table for each value of the grid
        models = {"raw": (factors, regress.solve_ridge(sums[i], factors, alpha)), "graph": ([*factors, *names], regress.solve_ridge(sums[i], [*factors, *names], alpha))}
        part = _scored(test.where(F.col("g") == i), models, ["t", "id"]).withColumn("k_neighbors", F.lit(ks[i]))
        out = part if out is None else out.unionAll(part)
    return _compared(stored(out, "sweep-predictions"), "k_neighbors")


def sweep_gamma(cleaned: DataFrame, edges: DataFrame, factors: list[str], beta_self: list[float], beta_near: list[float], gammas: list[float]) -> DataFrame:
    """(gamma, r2, mean_ic) of the spillover score against the next period's outcome; neighbours are aggregated once."""
    own = cleaned.select("t", "id", "y", neighbours.dot(factors, beta_self).alias("own"), neighbours.dot(factors, beta_near).alias("exposure"))
    spread = neighbours.neighbor_features(own, edges, ["exposure"], ["spread"])
    data = panel.align_target(own.join(spread, ["t", "id"]), ["own", "spread"])
    each = F.explode(F.array(*[F.lit(float(g)) for g in gammas]))
    scores = data.withColumn("gamma", each).select(F.col("gamma").cast("string").alias("model"), "t", "id", F.col("y").alias("y_true"), (F.col("own") + F.col("gamma") * F.col("spread")).alias("y_pred"))
    table = metrics.pooled_errors(scores).join(metrics.ic_ir(metrics.ic(scores), "ic"), "model")
    return table.select(F.col("model").cast("double").alias("gamma"), "r2", "mean_ic")
