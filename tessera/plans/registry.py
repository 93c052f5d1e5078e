"""The operators as queries over the given tables, and their oracles.

Doubles are rounded to six digits in both engines, because sums of doubles depend
on their order. Where averages of prices can end in an exact 5, both engines round by
the same steps (``FLOOR(ROUND(x, 9) * 1e6 + 0.5) / 1e6``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compare, diagnostics, graph, knn, metrics, neighbours, panel, portfolio, regress, trees
from tessera.functions.tables import shared_path, stored
from tessera.plans import jobs
from tessera.plans.job_oracles import diagnosed, experiment, increments, placebo, recursive, sweep
from tessera.plans.oracles import CTE, FACTORS, sql
from tessera.sources import panels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BETA_SELF, BETA_NEAR = [0.5, -0.3, 0.2, 0.1, -0.2], [0.3, -0.2, 0.1, 0.0, -0.1]


def query(*names: str, last: str | None = None, **other):
    """Registers a query under its function's name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if last is not None:
            ORACLE_SQL[f.__name__] = sql(*names, last=last, **other)
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return compare.round_table(df)


def _r(columns: str) -> str:
    return ", ".join(f"ROUND({c}, 6) AS {c}" for c in columns.split())


def half_up(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits by plain arithmetic, the same in every engine."""
    return df.select(*[(F.floor(F.round(c, 9) * 1e6 + 0.5) / 1e6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _h(columns: str) -> str:
    return ", ".join(f"FLOOR(ROUND({c}, 9) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS {c}" for c in columns.split())


def sm(spark: SparkSession, sf: str) -> DataFrame:
    return panels.supplier_months(spark, sf)


def ud(spark: SparkSession, sf: str) -> DataFrame:
    return panels.user_days(spark, sf)


def pred(spark: SparkSession, sf: str) -> DataFrame:
    return panels.predictions(sm(spark, sf))


def z(spark: SparkSession, sf: str) -> DataFrame:
    return panel.zscore_cs(sm(spark, sf), FACTORS)


def zr(spark: SparkSession, sf: str) -> DataFrame:
    return z(spark, sf).withColumns({f: F.round(f, 6) for f in FACTORS})


def symmetric_ring(spark: SparkSession, sf: str) -> DataFrame:
    return graph.symmetrize(panels.ring(sm(spark, sf)))


F5 = "f1 f2 f3 f4 f5"
PANEL = f"t, id, {_r(F5 + ' y')}"


# -- sources, cleaning, alignment ----------------------------------------------

@query("panel", last=f"SELECT {PANEL} FROM panel")
def load_panel(spark, sf):
    return rounded(sm(spark, sf))


@query("grid", last=f"SELECT t, id, {_r('f1 f2 f3 y')} FROM grid")
def load_grid_panel(spark, sf):
    return rounded(ud(spark, sf))


@query("panel", last=f"SELECT t, id, {_r(F5)} FROM panel")
def raw_features(spark, sf):
    return rounded(panel.raw_features(sm(spark, sf), FACTORS))


@query("panel", last=f"SELECT t, id, {_r(F5)} FROM panel WHERE t < (SELECT MAX(t) FROM panel)")
def lagged_features(spark, sf):
    return rounded(panel.lagged_features(sm(spark, sf), FACTORS))


@query("aligned", last=f"SELECT {PANEL} FROM aligned")
def align_target(spark, sf):
    return rounded(panel.align_target(sm(spark, sf), FACTORS))


@query("e", last="SELECT * FROM e WHERE t < (SELECT MAX(t) FROM panel)")
def align_graph(spark, sf):
    p = sm(spark, sf)
    return panel.align_graph(panels.ring(p), panel.periods(p))


@query("panel", last="""SELECT t, id, CASE WHEN t < FLOOR(n*0.6::DOUBLE) THEN 'train' WHEN t < FLOOR(n*(0.6::DOUBLE+0.2::DOUBLE)) THEN 'valid' ELSE 'test' END AS part
    FROM panel, (SELECT MAX(t)+1 AS n FROM panel)""")
def time_split(spark, sf):
    p = sm(spark, sf)
    return panel.time_split(p.select("t", "id"), panel.periods(p))


@query("grid", last="SELECT t, id, " + ", ".join(f"ROUND(COALESCE({f}, 0), 6) AS {f}" for f in ("f1", "f2", "f3")) + ", ROUND(y, 6) AS y FROM grid")
def fillna_zero(spark, sf):
    return rounded(panel.fillna_zero(ud(spark, sf), ["f1", "f2", "f3"]))


@query("grid", last="SELECT t, id, " + ", ".join(f"ROUND(COALESCE({f}, AVG({f}) OVER ()), 6) AS {f}" for f in ("f1", "f2", "f3")) + ", ROUND(y, 6) AS y FROM grid")
def fillna_mean(spark, sf):
    return rounded(panel.fillna_mean(ud(spark, sf), ["f1", "f2", "f3"]))


@query("z", last=f"SELECT {PANEL} FROM z")
def zscore_cs(spark, sf):
    return rounded(z(spark, sf))


@query("panel", last="SELECT t, id, ROUND(y, 6) AS y, " + ", ".join(f"ROUND(({f} - AVG({f}) OVER ())/STDDEV_POP({f}) OVER (), 6) AS {f}" for f in FACTORS) + " FROM panel")
def zscore_global(spark, sf):
    return rounded(panel.zscore_global(sm(spark, sf), FACTORS))


@query("winsor", last=f"SELECT t, id, {_h(F5 + ' y')} FROM winsor")
def winsorize_cs(spark, sf):
    return half_up(panel.winsorize_cs(sm(spark, sf), FACTORS))


@query("clean", last=f"SELECT {PANEL} FROM clean")
def preprocess_panel(spark, sf):
    return rounded(panel.preprocess_panel(sm(spark, sf), FACTORS))


@query("aligned", last=f"SELECT ROW_NUMBER() OVER (ORDER BY t, id) - 1 AS row, {_r(F5 + ' y')} FROM aligned")
def raw_dataset(spark, sf):
    return rounded(panel.raw_dataset(sm(spark, sf), FACTORS))


@query("panel", last=f"SELECT ROW_NUMBER() OVER (ORDER BY t, id) - 1 AS row, {_r(F5 + ' y')} FROM panel")
def flatten_panel(spark, sf):
    return rounded(panel.flatten_panel(sm(spark, sf), FACTORS))


# -- graphs ------------------------------------------------------------------------

@query("pairs", last="SELECT t, src, dst, ROUND(SQRT(score), 6) AS distance FROM pairs")
def pairwise_euclidean(spark, sf):
    return knn.scored_pairs(zr(spark, sf), FACTORS, True).select("t", "src", "dst", F.round(F.sqrt("score"), 6).alias("distance"))


@query("knn", last="SELECT t, src, dst, ROUND(score, 6) AS score, CAST(rank AS INT) AS rank FROM knn")
def knn_topk(spark, sf):
    return rounded(knn.knn_topk(zr(spark, sf), FACTORS, 10, short="all"))


@query("factor_graph", last="SELECT t, src, dst, ROUND(w, 6) AS w FROM factor_graph")
def factor_knn_graph(spark, sf):
    return rounded(knn.factor_knn_graph(zr(spark, sf), FACTORS, 10, short="all"))


@query(last="""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / SQRT(list_dot_product(v, v))) AS v FROM v),
    s AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS score FROM u a JOIN u b ON a.id <> b.id),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s)
    SELECT 0 AS t, src, dst, ROUND(LEAST(score, 1), 6) AS w FROM k WHERE rank <= 10 AND score > 0""")
def factor_cosine_graph(spark, sf):
    points, names = panels.embedding_section(spark, sf)
    return rounded(knn.factor_cosine_graph(points, names, 10, symmetric=False, row_norm=False))


_CORR = """WITH {ctes}, w AS (SELECT a.t, a.id, b.t AS s, b.y FROM grid a JOIN grid b ON b.id = a.id AND b.t BETWEEN a.t - 11 AND a.t), c AS (SELECT t, id, s, y - AVG(y) OVER (PARTITION BY t, id) AS y FROM w),
    n AS (SELECT t, id, SQRT(SUM(y*y)) AS n FROM c GROUP BY 1, 2),
    s AS (SELECT a.t, a.id AS src, b.id AS dst, ROUND(SUM(a.y * b.y)/(CASE WHEN ANY_VALUE(na.n) < 1e-12 THEN 1 ELSE ANY_VALUE(na.n) END * CASE WHEN ANY_VALUE(nb.n) < 1e-12 THEN 1 ELSE ANY_VALUE(nb.n) END), 9) AS score
      FROM c a JOIN c b ON a.t = b.t AND a.s = b.s AND a.id <> b.id JOIN n na ON na.t = a.t AND na.id = a.id JOIN n nb ON nb.t = b.t AND nb.id = b.id GROUP BY 1, 2, 3)"""


def _grid_ctes() -> str:
    return sql("grid", last="")[5:].strip()


@query()
def return_corr_knn(spark, sf):
    return rounded(knn.return_corr_graph(ud(spark, sf), 12, 10, digits=9, symmetric=False, row_norm=False))


ORACLE_SQL["return_corr_knn"] = _CORR.format(ctes=_grid_ctes()) + ", k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY t, src ORDER BY score DESC, dst) AS rank FROM s) SELECT t, src, dst, ROUND(LEAST(score, 1), 6) AS w FROM k WHERE rank <= 10 AND score > 0"


@query()
def return_corr_threshold(spark, sf):
    return rounded(knn.return_corr_graph(ud(spark, sf), 12, None, 0.9, digits=9, symmetric=False, row_norm=False))


ORACLE_SQL["return_corr_threshold"] = _CORR.format(ctes=_grid_ctes()) + " SELECT t, src, dst, ROUND(LEAST(score, 1), 6) AS w FROM s WHERE score >= 0.9 AND score > 0"


@query()
def random_null_graph(spark, sf):
    return knn.random_null_graph(graph.nodes_of(sm(spark, sf)), 5)


ORACLE_SQL["random_null_graph"] = recursive(sql("placebo", last="SELECT * FROM placebo", **placebo("nodes", 5)))


@query("e", "nodes", last="SELECT t, src, dst, SUM(w) AS w FROM (SELECT * FROM e UNION ALL SELECT t, id, id, 1.0 FROM nodes) GROUP BY 1, 2, 3")
def add_self_loops(spark, sf):
    p = sm(spark, sf)
    return graph.add_self_loops(panels.ring(p), graph.nodes_of(p))


@query("e", "nodes", last="SELECT n.t, n.id, COALESCE(SUM(e.w), 0) AS d FROM nodes n LEFT JOIN e ON e.t = n.t AND e.src = n.id GROUP BY 1, 2")
def degree(spark, sf):
    p = sm(spark, sf)
    return graph.degree(panels.ring(p), graph.nodes_of(p))


@query("sym", last="SELECT t, src, dst, ROUND(w / SUM(w) OVER (PARTITION BY t, src), 6) AS w FROM sym")
def row_normalize(spark, sf):
    return rounded(graph.row_normalize(symmetric_ring(spark, sf)))


@query("gcn", last="SELECT t, src, dst, ROUND(w, 6) AS w FROM gcn")
def gcn_normalize(spark, sf):
    return rounded(graph.gcn_normalize(symmetric_ring(spark, sf)))


@query("sym", last="SELECT t, src, dst, w FROM sym")
def symmetrize_mean(spark, sf):
    return symmetric_ring(spark, sf)


@query("e", last="SELECT t, src, dst, MAX(w) AS w FROM (SELECT * FROM e UNION ALL SELECT t, dst, src, w FROM e) GROUP BY 1, 2, 3")
def symmetrize_max(spark, sf):
    return graph.symmetrize(panels.ring(sm(spark, sf)), "max")


@query("gcn", "nodes", last="SELECT t, src, dst, ROUND(SUM(w), 6) AS w FROM (SELECT t, src, dst, -w AS w FROM gcn UNION ALL SELECT t, id, id, 1.0 FROM nodes) GROUP BY 1, 2, 3")
def laplacian(spark, sf):
    return rounded(graph.laplacian(symmetric_ring(spark, sf), graph.nodes_of(sm(spark, sf))))


@query("sym", "nodes", last="""SELECT t, src, dst, ROUND(SUM(w), 6) AS w FROM (SELECT t, src, dst, -w AS w FROM sym
    UNION ALL SELECT n.t, n.id, n.id, COALESCE(SUM(s.w), 0) FROM nodes n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id GROUP BY n.t, n.id) GROUP BY 1, 2, 3""")
def laplacian_plain(spark, sf):
    return rounded(graph.laplacian(symmetric_ring(spark, sf), graph.nodes_of(sm(spark, sf)), False))


@query("e", "z", last="SELECT e.t, e.src, e.dst, ROUND(p.f1, 6) AS w FROM e JOIN z p ON p.t = e.t AND p.id = e.src WHERE p.f1 > 0")
def ensure_nonnegative(spark, sf):
    own = z(spark, sf)
    signed = panels.ring(own).drop("w").join(own.select("t", F.col("id").alias("src"), F.col("f1").alias("w")), ["t", "src"])
    return rounded(graph.ensure_nonnegative(signed))


# -- neighbour features ------------------------------------------------------------

@query("near", last=f"SELECT t, id, {_r('f1 f2')} FROM near")
def neighbor_features(spark, sf):
    return rounded(neighbours.neighbor_features(sm(spark, sf), symmetric_ring(spark, sf), ["f1", "f2"]))


@query("near2", last=f"SELECT t, id, {_h('f1_h2 f2_h2')} FROM (SELECT t, id, f1 AS f1_h2, f2 AS f2_h2 FROM near2)")
def propagate_hops(spark, sf):
    return half_up(neighbours.propagate_hops(sm(spark, sf), symmetric_ring(spark, sf), ["f1", "f2"], 2)[-1])


@query("hop1", "hop2", last="SELECT p.t, p.id, " + ", ".join([f"ROUND(p.{f}, 6) AS {f}" for f in FACTORS] + [f"ROUND({n}.{f}, 6) AS {f}_{n}" for n in ("h1", "h2") for f in FACTORS]) + " FROM zr p JOIN hop1 h1 ON h1.t = p.t AND h1.id = p.id JOIN hop2 h2 ON h2.t = p.t AND h2.id = p.id")
def graph_features(spark, sf):
    """One and two hops of all factors on the factor graph."""
    p = stored(zr(spark, sf), "panel")
    edges = stored(knn.factor_knn_graph(p, FACTORS, 10, short="all", symmetric=False, row_norm=False), "neighbours")
    return rounded(neighbours.graph_features(p, edges, FACTORS, 2, finish={}))


_OWN = "(0.5*{p}.f1 - 0.3*{p}.f2 + 0.2*{p}.f3 + 0.1*{p}.f4 - 0.2*{p}.f5)"
_EXP = "(0.3*{p}.f1 - 0.2*{p}.f2 + 0.1*{p}.f3 - 0.1*{p}.f5)"


@query("z", last=f"SELECT t, id, ROUND({_OWN.format(p='z')}, 6) AS score FROM z")
def self_score(spark, sf):
    return rounded(neighbours.self_score(z(spark, sf), FACTORS, BETA_SELF))


def _spill(gamma: str) -> str:
    return f"ROUND(ANY_VALUE({_OWN.format(p='n')}) + {gamma}*COALESCE(SUM(s.w * {_EXP.format(p='p')}), 0), 6) AS score"


@query("z", "sym", last=f"SELECT n.t, n.id, {_spill('0.8')} FROM z n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN z p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2")
def spillover_score(spark, sf):
    return rounded(neighbours.spillover_score(z(spark, sf), symmetric_ring(spark, sf), FACTORS, BETA_SELF, BETA_NEAR, 0.8))


_NATION = ([], "SELECT a.s_suppkey AS src, b.s_suppkey AS dst, 1.0::DOUBLE / (b.s_suppkey - a.s_suppkey) AS w FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey BETWEEN a.s_suppkey + 1 AND a.s_suppkey + 30")


@query("z", "nation_edges", last=f"SELECT n.t, n.id, {_spill('0.8')} FROM z n LEFT JOIN nation_edges s ON s.src = n.id LEFT JOIN z p ON p.t = n.t AND p.id = s.dst GROUP BY 1, 2", nation_edges=_NATION)
def spillover_score_static(spark, sf):
    """The spillover over one graph for all periods."""
    return rounded(neighbours.spillover_score(z(spark, sf), panels.nation_graph(spark, sf), FACTORS, BETA_SELF, BETA_NEAR, 0.8))


def _static_hop(of: str) -> str:
    return f"SELECT n.t, n.id, COALESCE(SUM(s.w * p.f1), 0) AS f1, COALESCE(SUM(s.w * p.f2), 0) AS f2 FROM {of} n LEFT JOIN nation_edges s ON s.src = n.id LEFT JOIN {of} p ON p.t = n.t AND p.id = s.dst GROUP BY 1, 2"


@query("z", "nation_edges", "one", "two", last="SELECT t, id, ROUND(f1, 6) AS f1_h2, ROUND(f2, 6) AS f2_h2 FROM two", nation_edges=_NATION, one=(["z", "nation_edges"], _static_hop("z")), two=(["one"], _static_hop("one")))
def propagate_hops_static(spark, sf):
    """Two hops over one graph for all periods, whose edges are dealt once."""
    return rounded(neighbours.propagate_hops(z(spark, sf), panels.nation_graph(spark, sf), ["f1", "f2"], 2)[-1])


@query("z", last=f"SELECT t, id, ROUND({_OWN.format(p='z')} + y, 6) AS score FROM z")
def hidden_score(spark, sf):
    p = z(spark, sf)
    return rounded(neighbours.hidden_score(p, p.select("t", "id", F.col("y").alias("h")), FACTORS, BETA_SELF))


LAYERS = [([[1.0, -1.0], [0.0, 1.0]], [0.0, 0.5]), ([[1.0], [2.0]], [-1.0])]
_HIDDEN = """SELECT n.t, n.id, GREATEST(COALESCE(SUM(s.w * p.f1), 0), 0) AS h0, GREATEST(COALESCE(SUM(s.w * (p.f4 - p.f1)), 0) + 0.5, 0) AS h1
    FROM z n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN z p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2"""


@query("z", "sym", last=f"SELECT t, id, ROUND(h0, 6) AS g0, ROUND(h1, 6) AS g1 FROM ({_HIDDEN})")
def gcn_features(spark, sf):
    return rounded(neighbours.gcn_features(z(spark, sf), symmetric_ring(spark, sf), ["f1", "f4"], *LAYERS[0]))


@query("z", "sym", last=f"SELECT n.t, n.id, ROUND(COALESCE(SUM(s.w * (p.h0 + 2*p.h1)), 0) - 1, 6) AS y_pred FROM z n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN ({_HIDDEN}) p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2")
def gcn_predict(spark, sf):
    return rounded(neighbours.gcn_predict(z(spark, sf), symmetric_ring(spark, sf), ["f1", "f4"], LAYERS))


# -- models ----------------------------------------------------------------------

def _zaligned(spark, sf):
    return panel.align_target(z(spark, sf), ["f1", "f4"])


def _closed(alpha: float, by: str = "") -> str:
    """Centred two-factor normal equations, solved in closed form."""
    n = "COUNT(*)"
    return f"""SELECT {by} m1, m4, my, (a4*c1 - a14*c4)/(a1*a4 - a14*a14) AS b1, (a1*c4 - a14*c1)/(a1*a4 - a14*a14) AS b4 FROM (SELECT {by} AVG(f1) AS m1, AVG(f4) AS m4, AVG(y) AS my,
    VAR_POP(f1)*{n} + {alpha} AS a1, VAR_POP(f4)*{n} + {alpha} AS a4, COVAR_POP(f1, f4)*{n} AS a14, COVAR_POP(f1, y)*{n} AS c1, COVAR_POP(f4, y)*{n} AS c4 FROM zaligned {{where}} {'GROUP BY ' + by.rstrip(', ') if by else ''})"""


_COEF = "SELECT ROUND(my - b1*m1 - b4*m4, 6) AS intercept, ROUND(b1, 6) AS beta_f1, ROUND(b4, 6) AS beta_f4 FROM ({})"


def _coef_row(spark, coef):
    b0, (b1, b4) = coef
    return spark.range(1).select(F.round(F.lit(b0), 6).alias("intercept"), F.round(F.lit(b1), 6).alias("beta_f1"), F.round(F.lit(b4), 6).alias("beta_f4"))


@query("zaligned", last=_COEF.format(_closed(0.0).format(where="")))
def fit_ols(spark, sf):
    return _coef_row(spark, regress.fit_ols(_zaligned(spark, sf), ["f1", "f4"]))


@query("zaligned", last=_COEF.format(_closed(10.0).format(where="")))
def fit_ridge(spark, sf):
    return _coef_row(spark, regress.fit_ridge(_zaligned(spark, sf), ["f1", "f4"], 10.0))


_TRAIN = "WHERE t < (SELECT FLOOR(MAX(t) * 0.6::DOUBLE) FROM panel)"


@query("zaligned", "panel", last=f"SELECT a.t, a.id, ROUND(a.y, 6) AS y, ROUND(my - b1*m1 - b4*m4 + b1*a.f1 + b4*a.f4, 6) AS y_pred FROM zaligned a, ({_closed(1.0).format(where=_TRAIN)}) WHERE a.t >= (SELECT FLOOR(MAX(t) * (0.6::DOUBLE + 0.2::DOUBLE)) FROM panel)")
def linear_baseline(spark, sf):
    data = _zaligned(spark, sf)
    total = panel.periods(sm(spark, sf)) - 1
    parts = panel.time_split(data, total)
    coef = regress.fit_ridge(parts.where("part = 'train'"), ["f1", "f4"], 1.0)
    return rounded(regress.predict_linear(parts.where("part = 'test'"), ["f1", "f4"], coef).select("t", "id", "y", "y_pred"))


@query("zaligned", last=f"SELECT t, ROUND(my - b1*m1 - b4*m4, 6) AS intercept, ROUND(b1, 6) AS beta_f1, ROUND(b4, 6) AS beta_f4 FROM ({_closed(0.0, 't, ').format(where='')})")
def fit_ols_per_period(spark, sf):
    fits = regress.fit_per_period(_zaligned(spark, sf), ["f1", "f4"])
    return rounded(fits.select("t", "intercept", F.col("beta")[0].alias("beta_f1"), F.col("beta")[1].alias("beta_f4")))


@query("pred", last="SELECT model, ROUND(AVG(mse), 6) AS loss FROM (SELECT model, t, AVG((y_true-y_pred)*(y_true-y_pred)) AS mse FROM pred GROUP BY 1, 2) GROUP BY 1")
def panel_loss(spark, sf):
    return rounded(regress.panel_loss(pred(spark, sf)))


def _sgc_hop(of: str) -> tuple[list[str], str]:
    return [of, "normal"], f"SELECT n.t, n.id, COALESCE(SUM(s.w * p.f1), 0) AS f1, COALESCE(SUM(s.w * p.f4), 0) AS f4 FROM {of} n LEFT JOIN normal s ON s.t = n.t AND s.src = n.id LEFT JOIN {of} p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2"


_VALID = "(SELECT FLOOR(MAX(t) * 0.6::DOUBLE) FROM panel)", "(SELECT FLOOR(MAX(t) * (0.6::DOUBLE + 0.2::DOUBLE)) FROM panel)"
_SGC = {
    "looped": (["sym", "nodes"], "SELECT t, src, dst, w FROM sym UNION ALL SELECT t, id, id, 1.0::DOUBLE FROM nodes"),
    "normal": (["looped"], CTE["gcn"][1].replace("sym", "looped")),
    "near1": _sgc_hop("z"),
    "near2": _sgc_hop("near1"),
    "designs": (["near1", "near2", "z"], "SELECT c.*, b.y FROM (SELECT 1 AS h, t, id, f1, f4 FROM near1 UNION ALL SELECT 2, t, id, f1, f4 FROM near2) c JOIN z b ON b.id = c.id AND b.t = c.t + 1"),
    "solved": (
        ["designs", "panel"],
        f"""SELECT h, 'hops=' || h || ' alpha=' || name AS model, m1, m4, my, ((a4+al)*c1 - a14*c4)/((a1+al)*(a4+al) - a14*a14) AS b1, ((a1+al)*c4 - a14*c1)/((a1+al)*(a4+al) - a14*a14) AS b4
        FROM (SELECT h, AVG(f1) AS m1, AVG(f4) AS m4, AVG(y) AS my, VAR_POP(f1)*COUNT(*) AS a1, VAR_POP(f4)*COUNT(*) AS a4, COVAR_POP(f1, f4)*COUNT(*) AS a14, COVAR_POP(f1, y)*COUNT(*) AS c1, COVAR_POP(f4, y)*COUNT(*) AS c4
        FROM designs WHERE t < {_VALID[0]} GROUP BY h), (VALUES ('0.1', 0.1::DOUBLE), ('10.0', 10.0::DOUBLE)) AS g(name, al)""",
    ),
    "tried": (["solved", "designs"], "SELECT model, t, id, y AS y_true, my + b1*(f1 - m1) + b4*(f4 - m4) AS y_pred FROM designs JOIN solved USING (h)"),
    "losses": (["tried", "panel"], f"SELECT model, AVG(m) AS loss FROM (SELECT model, t, AVG((y_true-y_pred)*(y_true-y_pred)) AS m FROM tried WHERE t >= {_VALID[0]} AND t < {_VALID[1]} GROUP BY 1, 2) GROUP BY 1"),
}


@query("losses", "tried", "panel", last=f"SELECT model, t, id, ROUND(y_true, 6) AS y_true, ROUND(y_pred, 6) AS y_pred FROM tried WHERE t >= {_VALID[1]} AND model = (SELECT model FROM losses ORDER BY loss, model LIMIT 1)", **_SGC)
def fit_sgc(spark, sf):
    """Linear graph convolution: the last hop's features on the normalised graph, then ridge, chosen on the validation part."""
    p = stored(z(spark, sf).select("t", "id", "f1", "f4", "y"), "sgc")
    edges = graph.gcn_normalize(graph.add_self_loops(symmetric_ring(spark, sf), graph.nodes_of(p)))
    return rounded(jobs.convolution(p, edges, ["f1", "f4"]))


def _tree_rows(spark, sf):
    return stored(panel.time_split(panel.align_target(z(spark, sf), FACTORS), panel.periods(sm(spark, sf)) - 1), "trees")


@query()
def fit_random_forest(spark, sf):
    """200 trees of any depth on all factors; histograms decide in nodes of over 20,000 rows."""
    data = _tree_rows(spark, sf)
    forest = trees.fit_forest(data.where("part = 'train'"), FACTORS, ["t", "id"], small=20_000)
    return rounded(trees.predict_forest(data.where("part = 'test'"), forest).select("t", "id", "y", "y_pred"))


@query()
def fit_boosted_trees(spark, sf):
    """With the default number of trees, on all factors."""
    data = _tree_rows(spark, sf)
    model = regress.fit_trees(data.where("part = 'train'"), FACTORS, "boosted")
    return rounded(model.transform(data.where("part = 'test'")).select("t", "id", "y", "y_pred"))


# -- metrics and portfolios --------------------------------------------------------

@query("errors", last=f"SELECT model, {_r('mse mae r2')} FROM errors")
def pooled_errors(spark, sf):
    return rounded(metrics.pooled_errors(pred(spark, sf)))


@query("ics", last="SELECT model, t, ROUND(ic, 6) AS ic FROM ics")
def ic(spark, sf):
    return rounded(metrics.ic(pred(spark, sf)))


@query("avgranks", last="SELECT model, t, id, rb AS rank FROM avgranks")
def average_rank(spark, sf):
    return metrics.with_average_rank(pred(spark, sf), "y_pred", "rank", ["model", "t"]).select("model", "t", "id", "rank")


@query("rics", last="SELECT model, t, ROUND(rank_ic, 6) AS rank_ic FROM rics")
def rank_ic(spark, sf):
    return rounded(metrics.rank_ic(pred(spark, sf)))


@query("ics", last="SELECT model, ROUND(AVG(ic), 6) AS mean_ic, ROUND(AVG(ic)/STDDEV_POP(ic), 6) AS ic_ir FROM ics GROUP BY 1")
def ic_ir(spark, sf):
    return rounded(metrics.ic_ir(metrics.ic(pred(spark, sf)), "ic"))


_METRICS = "mse mae r2 mean_ic ic_ir mean_rank_ic rank_ic_ir"
_ALL = _METRICS + " mean_ls_return ls_sharpe group_1_ret group_2_ret group_3_ret group_4_ret group_5_ret"


@query("summary", last=f"SELECT model, {_r(_METRICS)} FROM summary")
def evaluate_predictions(spark, sf):
    return rounded(metrics.evaluate_predictions(pred(spark, sf)))


@query("ranked", last="SELECT model, t, id, CAST((rank0 * 4) // size AS INT) AS bin FROM ranked")
def quantile_bins(spark, sf):
    return portfolio.quantile_bins(pred(spark, sf), 4).select("model", "t", "id", "bin")


@query("ranked", last="SELECT model, t, CAST((rank0 * 5) // size AS INT) AS bin, ROUND(AVG(y_true), 6) AS ret FROM ranked GROUP BY 1, 2, 3")
def quantile_returns(spark, sf):
    return rounded(portfolio.quantile_returns(pred(spark, sf)))


@query("groups", last="SELECT model, bin, ROUND(ret, 6) AS ret FROM groups")
def mean_group_returns(spark, sf):
    return rounded(portfolio.mean_group_returns(pred(spark, sf)))


@query("ls", last="SELECT model, t, ROUND(ls, 6) AS ls FROM ls")
def long_short(spark, sf):
    return rounded(portfolio.long_short(pred(spark, sf)))


@query("ls", last="SELECT model, ROUND(AVG(ls), 6) AS mean_ls_return, ROUND(AVG(ls)/STDDEV_POP(ls)*SQRT(12), 6) AS ls_sharpe FROM ls GROUP BY 1")
def sharpe(spark, sf):
    return rounded(portfolio.sharpe(portfolio.long_short(pred(spark, sf)), periods=12))


@query("ls", last="SELECT model, t, ROUND(PRODUCT(1 + ls) OVER (PARTITION BY model ORDER BY t) - 1, 6) AS cum FROM ls")
def cumulative_returns(spark, sf):
    return rounded(portfolio.cumulative_returns(portfolio.long_short(pred(spark, sf))))


@query("summary", last=f"SELECT model, {_r(_ALL[len(_METRICS) + 1:])} FROM summary")
def evaluate_portfolio(spark, sf):
    return rounded(portfolio.evaluate_portfolio(pred(spark, sf)))


@query("summary", last=f"SELECT model, {_r(_ALL)} FROM summary")
def model_summary(spark, sf):
    return rounded(compare.model_summary(pred(spark, sf)))


@query("summary", last="SELECT " + ", ".join(f"ROUND(b.{c} - a.{c}, 6) AS {c}" for c in _ALL.split()) + " FROM summary a, summary b WHERE a.model = 'a' AND b.model = 'b'")
def model_delta(spark, sf):
    return rounded(compare.model_delta(compare.model_summary(pred(spark, sf)), "a", "b"))


@query("summary", last="SELECT 'suppliers' AS scenario, ROUND(MAX(CASE WHEN model='a' THEN r2 END), 6) AS a_r2, ROUND(MAX(CASE WHEN model='a' THEN mean_ic END), 6) AS a_mean_ic, ROUND(MAX(CASE WHEN model='b' THEN r2 END), 6) AS b_r2, ROUND(MAX(CASE WHEN model='b' THEN mean_ic END), 6) AS b_mean_ic FROM summary")
def scenario_summary(spark, sf):
    table = metrics.evaluate_predictions(pred(spark, sf)).withColumn("scenario", F.lit("suppliers"))
    return rounded(compare.scenario_summary(table, ["a", "b"]))


# -- diagnostics -----------------------------------------------------------------

_Y = "(SELECT t, id, y, y - AVG(y) OVER (PARTITION BY t) AS c, COUNT(*) OVER (PARTITION BY t) AS n, VAR_POP(y) OVER (PARTITION BY t) * COUNT(*) OVER (PARTITION BY t) AS zz FROM panel)"


@query("sym", "panel", last=f"SELECT a.t, ROUND(ANY_VALUE(a.n)/SUM(s.w)*SUM(s.w*a.c*b.c)/ANY_VALUE(a.zz), 6) AS moran_i FROM sym s JOIN {_Y} a ON a.t = s.t AND a.id = s.src JOIN {_Y} b ON b.t = s.t AND b.id = s.dst GROUP BY 1")
def morans_i(spark, sf):
    return rounded(diagnostics.morans_i(sm(spark, sf), symmetric_ring(spark, sf)))


@query("gcn", "panel", last="SELECT o.t, ROUND(o.s - x.s, 6) AS dirichlet_energy FROM (SELECT t, SUM(y*y) AS s FROM panel GROUP BY 1) o JOIN (SELECT g.t, SUM(g.w*a.y*b.y) AS s FROM gcn g JOIN panel a ON a.t = g.t AND a.id = g.src JOIN panel b ON b.t = g.t AND b.id = g.dst GROUP BY 1) x USING (t)")
def dirichlet_energy(spark, sf):
    return rounded(diagnostics.dirichlet_energy(sm(spark, sf), symmetric_ring(spark, sf)))


@query("sym", "panel", last="SELECT s.t, ROUND(SUM(s.w*a.y*a.y) - SUM(s.w*a.y*b.y), 6) AS dirichlet_energy FROM sym s JOIN panel a ON a.t = s.t AND a.id = s.src JOIN panel b ON b.t = s.t AND b.id = s.dst GROUP BY 1")
def dirichlet_energy_plain(spark, sf):
    return rounded(diagnostics.dirichlet_energy(sm(spark, sf), symmetric_ring(spark, sf), normalized=False))


@query("sym", "panel", last="""SELECT t, ROUND(COALESCE(COVAR_POP(y, m)/NULLIF(STDDEV_POP(y)*STDDEV_POP(m), 0), 0), 6) AS residual_corr FROM (SELECT n.t, n.id, n.y, COALESCE(SUM(s.w*p.y)/SUM(s.w), 0) AS m
    FROM panel n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN panel p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2, 3) GROUP BY 1""")
def neighbor_residual_corr(spark, sf):
    return rounded(diagnostics.neighbor_residual_corr(sm(spark, sf), symmetric_ring(spark, sf), "y"))


@query("sym", "z", last="""SELECT t, ROUND(c1*c1/(a1*yy), 6) AS r2_base, ROUND((c1*(a2*c1 - a12*c2) + c2*(a1*c2 - a12*c1))/((a1*a2 - a12*a12)*yy), 6) AS r2_full,
    ROUND((c1*(a2*c1 - a12*c2) + c2*(a1*c2 - a12*c1))/((a1*a2 - a12*a12)*yy) - c1*c1/(a1*yy), 6) AS delta_r2
    FROM (SELECT t, VAR_POP(f1) AS a1, VAR_POP(m) AS a2, COVAR_POP(f1, m) AS a12, COVAR_POP(f1, y) AS c1, COVAR_POP(m, y) AS c2, VAR_POP(y) AS yy FROM (SELECT n.t, n.id, n.f1, n.y, COALESCE(SUM(s.w*p.f1)/SUM(s.w), 0) AS m
    FROM z n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN z p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2, 3, 4) GROUP BY 1)""")
def incremental_r2(spark, sf):
    return rounded(diagnostics.incremental_r2(z(spark, sf), symmetric_ring(spark, sf), ["f1"]).select("t", "r2_base", "r2_full", "delta_r2"))


@query()
def incremental_r2_all(spark, sf):
    """All factors and their neighbours on the factor graph against the next outcome, with and without an intercept."""
    p = stored(panel.align_target(zr(spark, sf), FACTORS), "panel")
    edges = stored(knn.factor_knn_graph(p, FACTORS, 10, short="all", symmetric=False, row_norm=False), "neighbours")
    both = stored(diagnostics.with_neighbours(p, edges, FACTORS, finish={}), "with-neighbours")
    each = [diagnostics.r2_by_neighbours(both, FACTORS, intercept=i).select(F.lit(i).alias("intercept"), "t", "r2_base", "r2_full", "delta_r2") for i in (True, False)]
    return rounded(each[0].unionAll(each[1]))


@query()
def diagnostics_summary(spark, sf):
    """A factor graph and the placebo graph, one row each; the outcome is the next period's."""
    p = stored(panel.align_target(zr(spark, sf), FACTORS), "panel")
    real = stored(knn.factor_knn_graph(p, FACTORS, 10, short="all", symmetric=False, row_norm=False), "neighbours")
    null = stored(knn.random_null_graph(graph.nodes_of(p), 10), "placebo")
    return rounded(diagnostics.diagnostics_summary(p, real, FACTORS, "factor_knn", symmetric=True).unionAll(diagnostics.diagnostics_summary(p, null, FACTORS, "placebo", symmetric=False)))


# -- jobs --------------------------------------------------------------------------

_SORTED = (["clean"], "SELECT 'self' AS model, a.t, a.id, b.y AS y_true, ROUND(a.f2 - a.f3, 9) AS y_pred FROM clean a JOIN clean b ON b.id = a.id AND b.t = a.t + 1")


@query("summary", last=f"SELECT model, {_r(_ALL)} FROM summary", pred=_SORTED)
def factor_sort_study(spark, sf):
    """Does sorting suppliers by last month's cleaned factors sort this month's outcome?"""
    cleaned = panel.preprocess_panel(sm(spark, sf), FACTORS)
    scored = neighbours.self_score(cleaned, ["f2", "f3"], [1.0, -1.0]).withColumn("score", F.round("score", 9))
    data = panel.align_target(scored.join(cleaned.select("t", "id", "y"), ["t", "id"]), ["score"])
    pred = stored(data.select(F.lit("self").alias("model"), "t", "id", F.col("y").alias("y_true"), F.col("score").alias("y_pred")), "predictions")
    return rounded(compare.model_summary(pred))


#: How a job's graph is finished.
CONVOLVED = {"self_loop": True, "gcn_norm": True}


def _cleaned(spark, sf) -> DataFrame:
    return stored(panel.preprocess_panel(sm(spark, sf), FACTORS), "cleaned")


def _own_graph(cleaned: DataFrame) -> DataFrame:
    return stored(knn.factor_knn_graph(cleaned, FACTORS, 10, short="all", symmetric=False, row_norm=False), "neighbours")


@query()
def run_experiment(spark, sf):
    """Suppliers' own outcome and their factor graph: clean, graph, align, split, fit, score, compare; one row a model."""
    cleaned = _cleaned(spark, sf)
    return rounded(jobs.run_experiment(cleaned, _own_graph(cleaned), FACTORS, "factor_graph", CONVOLVED))


@query()
def run_experiment_self_only(spark, sf):
    """The outcome comes from the own factors of its period, so the graph should not help."""
    cleaned = _cleaned(spark, sf)
    own = stored(neighbours.self_score(cleaned, FACTORS, BETA_SELF).withColumnRenamed("score", "y").join(cleaned.drop("y"), ["t", "id"]), "self-only")
    return rounded(jobs.run_experiment(own, _own_graph(cleaned), FACTORS, "self_only", CONVOLVED))


@query()
def run_experiment_wrong_graph(spark, sf):
    """The outcome has a part that the factors don't show, and the graph is the placebo."""
    cleaned = _cleaned(spark, sf)
    hidden = cleaned.select("t", "id", F.col("y").alias("h"))
    scored = neighbours.hidden_score(cleaned, hidden, FACTORS, BETA_SELF, 10.0).withColumnRenamed("score", "y")
    own = stored(scored.join(cleaned.drop("y"), ["t", "id"]), "hidden")
    edges = stored(knn.random_null_graph(graph.nodes_of(own), 10), "placebo")
    return rounded(jobs.run_experiment(own, edges, FACTORS, "wrong_graph", CONVOLVED))


@query()
def sweep_k(spark, sf):
    """Raw and graph models for 3 to 20 neighbours, from one neighbour pass."""
    return rounded(jobs.sweep_k(_cleaned(spark, sf), FACTORS, [3, 5, 10, 15, 20]))


GAMMAS = [0.0, 0.2, 0.5, 0.8, 1.0]
_SPREAD = (["z", "sym"], f"""SELECT CAST(g AS VARCHAR) AS model, a.t, a.id, b.y AS y_true, own + g * spread AS y_pred FROM (SELECT n.t, n.id, ANY_VALUE({_OWN.format(p='n')}) AS own, COALESCE(SUM(s.w * {_EXP.format(p='p')}), 0) AS spread
    FROM z n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN z p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2) a JOIN z b ON b.id = a.id AND b.t = a.t + 1 CROSS JOIN (SELECT UNNEST([0.0, 0.2, 0.5, 0.8, 1.0]::DOUBLE[]) AS g)""")


@query("errors", "ics", last="SELECT CAST(model AS DOUBLE) AS gamma, ROUND(r2, 6) AS r2, ROUND(mean_ic, 6) AS mean_ic FROM errors JOIN (SELECT model, AVG(ic) AS mean_ic FROM ics GROUP BY 1) i USING (model)", pred=_SPREAD)
def sweep_gamma(spark, sf):
    """R2 and mean IC of the spillover score for each gamma; the neighbours are aggregated once."""
    return rounded(jobs.sweep_gamma(z(spark, sf), symmetric_ring(spark, sf), FACTORS, BETA_SELF, BETA_NEAR, GAMMAS))


@query("panel", "e", last="SELECT p.t, p.n_rows, COALESCE(g.n_edges, 0) AS n_edges, ROUND(p.mean_y, 6) AS mean_y FROM (SELECT t, COUNT(*) AS n_rows, AVG(y) AS mean_y FROM panel GROUP BY 1) p LEFT JOIN (SELECT t, COUNT(*) AS n_edges FROM e GROUP BY 1) g USING (t)")
def save_panel_graph(spark, sf):
    """Panel and edges written by period and read again: their rows in each period."""
    p = sm(spark, sf)
    path = panels.save_panel_graph(p, panels.ring(p), shared_path(spark, "panel-graph"))
    back, edges = spark.read.parquet(f"{path}/panel"), spark.read.parquet(f"{path}/edges")
    rows = back.groupBy("t").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("y").alias("mean_y"))
    return rounded(rows.join(edges.groupBy("t").agg(F.count(F.lit(1)).alias("n_edges")), "t", "left").select("t", "n_rows", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "mean_y"))


@query("summary", last=f"SELECT model, {_r(_ALL)} FROM summary")
def save_summary_csv(spark, sf):
    """Written as CSV and read again."""
    table = rounded(compare.model_summary(pred(spark, sf)))
    path = panels.save_summary_csv(table, shared_path(spark, "summary"))
    return spark.read.schema(table.schema).option("header", True).csv(path)


# -- oracles of whole jobs -----------------------------------------------------------

_OWN_CLEAN = " + ".join(f"({b}) * {f}" for b, f in zip(BETA_SELF, FACTORS, strict=True))
ORACLE_SQL |= {
    "incremental_r2_all": increments(),
    "diagnostics_summary": diagnosed(),
    "run_experiment": experiment("factor_graph", "y", _r(_ALL)),
    "run_experiment_self_only": experiment("self_only", _OWN_CLEAN, _r(_ALL)),
    "run_experiment_wrong_graph": experiment("wrong_graph", f"{_OWN_CLEAN} + 10 * y", _r(_ALL), placebo_graph=True),
    "sweep_k": sweep([3, 5, 10, 15, 20]),
}
