"""Graph diagnostics of a node variable or of regression residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.guards import correlation
from tessera.functions.tables import stored
from tessera.operators import periods
from tessera.operators.graph import degree, finished, gcn_normalize, nodes_of, row_normalize
from tessera.operators.neighbours import neighbor_features
from tessera.operators.regress import fit_per_period, residuals_per_period


def _ends(values: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """The edges with the variable at both ends."""
    near = values.select("t", F.col("id").alias("src"), F.col(column).alias("a"))
    far = values.select("t", F.col("id").alias("dst"), F.col(column).alias("b"))
    return edges.join(near, ["t", "src"]).join(far, ["t", "dst"])


def morans_i(values: DataFrame, edges: DataFrame, column: str = "y") -> DataFrame:
    """(t, moran_i) = N / sum w * sum w z z' / sum z^2; 0 where a denominator vanishes."""
    stats = values.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), (F.var_pop(column) * F.count(F.lit(1))).alias("zz"))
    centred = values.join(F.broadcast(stats.select("t", "m")), "t").select("t", "id", (F.col(column) - F.col("m")).alias("z"))
    cross = _ends(centred, edges, "z").groupBy("t").agg(F.sum("w").alias("ww"), F.sum(F.col("w") * F.col("a") * F.col("b")).alias("zwz"))
    joined = stats.join(cross, "t", "left")
    value = F.when((F.abs("ww") >= 1e-12) & (F.col("zz") >= 1e-12), F.col("n") / F.when(F.abs("ww") >= 1e-12, F.col("ww")) * F.col("zwz") / F.when(F.col("zz") >= 1e-12, F.col("zz")))
    return joined.select("t", F.coalesce(value, F.lit(0.0)).alias("moran_i"))


def dirichlet_energy(values: DataFrame, edges: DataFrame, column: str = "y", normalized: bool = True) -> DataFrame:
    """(t, dirichlet_energy) = y' L y, from a sum over nodes and one over edges."""
    nodes = values.select("t", "id", F.col(column).alias("v"))
    if normalized:
        own = nodes.groupBy("t").agg(F.sum(F.col("v") * F.col("v")).alias("own"))
        edges = gcn_normalize(edges)
    else:
        own = degree(edges, nodes.select("t", "id")).join(nodes, ["t", "id"]).groupBy("t").agg(F.sum(F.col("d") * F.col("v") * F.col("v")).alias("own"))
    cross = _ends(nodes, edges, "v").groupBy("t").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("cross"))
    return own.join(cross, "t", "left").select("t", (F.col("own") - F.coalesce("cross", F.lit(0.0))).alias("dirichlet_energy"))


def neighbor_residual_corr(values: DataFrame, edges: DataFrame, column: str = "residual") -> DataFrame:
    """(t, residual_corr): correlation of a node's value with its neighbours' mean (0 without neighbours)."""
    near = neighbor_features(values, row_normalize(edges), [column], ["_near"])
    return values.join(near, ["t", "id"]).groupBy("t").agg(correlation(column, "_near").alias("residual_corr"))


def with_neighbours(panel: DataFrame, edges: DataFrame, factors: list[str], target: str = "y", finish: dict | None = None) -> DataFrame:
    """(t, id, factors..., target, f_n...): the neighbours' factors by row-normalised edges; with ``finish`` the edges come unfinished (``periods``)."""
    names = [f"{f}_n" for f in factors]
    if finish is not None:
        if periods.fit(panel, edges):
            return periods.hops(panel, edges, factors, 1, lambda c, _: f"{c}_n", [*factors, target], **finish)
        edges = finished(edges, nodes_of(panel), **{**finish, "row_norm": False})
    near = neighbor_features(panel, row_normalize(edges), factors, names)
    return panel.select("t", "id", *factors, target).join(near, ["t", "id"])


def r2_by_neighbours(both: DataFrame, factors: list[str], target: str = "y", intercept: bool = True) -> DataFrame:
    """(t, r2_base, r2_full, delta_r2, betas) from the table of ``with_neighbours``."""
    fits = fit_per_period(both, [*factors, *[f"{f}_n" for f in factors]], target, factors, intercept)
    return fits.select("t", "r2_base", F.col("r2").alias("r2_full"), (F.col("r2") - F.col("r2_base")).alias("delta_r2"), "beta_base", F.concat(F.array("intercept"), "beta").alias("beta_full"))


def incremental_r2(panel: DataFrame, edges: DataFrame, factors: list[str], target: str = "y", intercept: bool = True) -> DataFrame:
    """(t, r2_base, r2_full, delta_r2, betas): what the neighbours' factors add in each period, in sample."""
    return r2_by_neighbours(with_neighbours(panel, edges, factors, target), factors, target, intercept)


def _at_once(panel: DataFrame, edges: DataFrame, factors: list[str], target: str, symmetric: bool = True) -> DataFrame:
    """(t, and the four diagnostics) from unfinished edges whose periods fit a task: sums over edges are sums over nodes of their neighbours' sums."""
    stats = panel.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m"), (F.var_pop(target) * F.count(F.lit(1))).alias("zz"))
    rest = residuals_per_period(panel, factors, target)
    nodes = panel.select("t", "id", *factors, F.col(target).alias("y")).join(rest, ["t", "id"]).join(F.broadcast(stats.select("t", "m")), "t")
    nodes = stored(nodes.withColumn("z", F.col("y") - F.col("m")).withColumn("one", F.lit(1.0)), "diagnostics")
    plain = periods.hops(nodes, edges, ["z", "one"], 1, lambda c, _: f"{c}_n", ["z"], symmetric=symmetric, row_norm=False)
    plain = plain.groupBy("t").agg(F.sum("one_n").alias("ww"), F.sum(F.col("z") * F.col("z_n")).alias("zwz"))
    normal = periods.hops(nodes, edges, ["y"], 1, lambda c, _: f"{c}_n", ["y"], symmetric=symmetric, gcn_norm=True)
    normal = normal.groupBy("t").agg(F.sum(F.col("y") * F.col("y")).alias("own"), F.sum(F.col("y") * F.col("y_n")).alias("cross"))
    means = stored(periods.hops(nodes, edges, [*factors, "residual"], 1, lambda c, _: f"{c}_n", [*factors, "y", "residual"], symmetric=symmetric), "means")
    value = F.when((F.abs("ww") >= 1e-12) & (F.col("zz") >= 1e-12), F.col("n") / F.when(F.abs("ww") >= 1e-12, F.col("ww")) * F.col("zwz") / F.when(F.col("zz") >= 1e-12, F.col("zz")))
    moran = stats.join(plain, "t").select("t", F.coalesce(value, F.lit(0.0)).alias("moran_i"))
    energy = normal.select("t", (F.col("own") - F.col("cross")).alias("dirichlet_energy"))
    residual = means.groupBy("t").agg(correlation("residual", "residual_n").alias("residual_corr"))
    return moran.join(energy, "t").join(residual, "t").join(r2_by_neighbours(means, factors).select("t", "delta_r2"), "t")


def diagnostics_summary(panel: DataFrame, edges: DataFrame, factors: list[str], scenario: str, target: str = "y", symmetric: bool | None = None) -> DataFrame:
    """One row: the means over periods of the four diagnostics.

    With ``symmetric`` (whether the edges are symmetrised first) what fits is done a period at a time (``periods``).
    """
    if symmetric is not None and periods.fit(panel, edges):
        joined = _at_once(panel, edges, factors, target, symmetric)
    else:
        if symmetric:
            edges = stored(finished(edges, nodes_of(panel), row_norm=False), "finished")
        rest = residuals_per_period(panel, factors, target)
        tables = [morans_i(panel, edges, target), dirichlet_energy(panel, edges, target), neighbor_residual_corr(rest, edges), incremental_r2(panel, edges, factors, target).select("t", "delta_r2")]
        joined = tables[0]
        for x in tables[1:]:
            joined = joined.join(x, "t")
    return joined.agg(*[F.avg(c).alias(c) for c in ("moran_i", "dirichlet_energy", "residual_corr", "delta_r2")]).select(F.lit(scenario).alias("scenario"), "*")
