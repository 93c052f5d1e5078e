"""Oracle SQL for whole jobs: placebo graphs, and regressions of many columns.

SQL has no solver, so a regression takes one column after another out of the
outcome and out of the columns that follow (Gram-Schmidt by windows). Ridge is
least squares with one more row for each column.
"""

from tessera.plans.oracles import CTE, FACTORS, sql

LONG = dict[str, tuple[list[str], str]]


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def feistel(x: str) -> str:
    """The oracle's form of the placebo's permutation of ``x``."""
    left, right = f"({x} // c)", f"({x} % c)"
    steps = []
    for turn in range(6):
        draw = "('0x' || substr(md5(concat_ws(':', 42, t, src, {turn}, {half})), 1, 8))::BIGINT"
        if turn % 2 == 0:
            left = f"(({left} + {draw.format(turn=turn, half='h' + str(turn))}) % r)"
            steps.append((f"h{turn}", right))
            right = f"h{turn}"
        else:
            right = f"(({right} + {draw.format(turn=turn, half='h' + str(turn))}) % c)"
            steps.append((f"h{turn}", left))
            left = f"h{turn}"
    source = f"(SELECT *, {steps[0][1]} AS h0 FROM q)"
    for name, value in steps[1:]:
        source = f"(SELECT *, {value} AS {name} FROM {source})"
    return f"SELECT t, src, n, c, r, {left} * c + {right} AS pos FROM {source}"


def placebo(nodes: str, k: int) -> LONG:
    """The view ``placebo`` over the nodes of a view."""
    turn = feistel("pos")
    return {
        "numbered": ([nodes], f"SELECT t, id, ROW_NUMBER() OVER (PARTITION BY t ORDER BY id) - 1 AS pos, COUNT(*) OVER (PARTITION BY t) AS n FROM {nodes}"),
        "start": (["numbered"], f"SELECT t, id AS src, n, CAST(CEIL(SQRT(n)) AS BIGINT) AS c, CAST(CEIL(n / CEIL(SQRT(n))) AS BIGINT) AS r, UNNEST(RANGE(LEAST({k}, n))) AS pos FROM numbered"),
        "walk": (["start"], f"{turn.replace('FROM q)', 'FROM start)')} UNION ALL {turn.replace('FROM q)', 'FROM walk WHERE pos >= n)')}"),
        "placebo": (["walk", "numbered"], "SELECT w.t, w.src, b.id AS dst, 1.0::DOUBLE AS w FROM walk w JOIN numbered b ON b.t = w.t AND b.pos = w.pos WHERE w.pos < w.n"),
    }


def _taken_out(prefix: str, columns: list[str], keep: str, window: str, fit: str = "TRUE") -> LONG:
    """Views prefix1, prefix2, ... after prefix0: each takes one column out; y is what is left of the outcome."""
    out = {}
    for k, c in enumerate(columns, 1):
        own = f"SUM(CASE WHEN {fit} THEN {c}*{c} END) {window}"
        rest = ", ".join(f"{r} - COALESCE(SUM(CASE WHEN {fit} THEN {r}*{c} END) {window} / CASE WHEN {own} > 1e-9 THEN {own} END, 0) * {c} AS {r}" for r in [*columns[k:], "y"])
        out[f"{prefix}{k}"] = ([f"{prefix}{k - 1}"], f"SELECT {keep}, {rest} FROM {prefix}{k - 1}")
    return out


def _hop(of: str, edges: str, factors: list[str] = FACTORS, names: list[str] | None = None) -> tuple[list[str], str]:
    sums = ", ".join(f"COALESCE(SUM(s.w * p.{f}), 0) AS {n}" for f, n in zip(factors, names or factors, strict=True))
    return [of, edges], f"SELECT n.t, n.id, {sums} FROM {of} n LEFT JOIN {edges} s ON s.t = n.t AND s.src = n.id LEFT JOIN {of} p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2"


def _normal(edges: str, name: str) -> LONG:
    return {name: ([edges], CTE["gcn"][1].replace("sym", edges))}


NEAR = [f"n{i}" for i in range(1, 6)]
#: The panel of both diagnostic jobs, and the factor graph over it.
_ALIGNED = {
    "za": (["zr"], "SELECT a.t, a.id, a.f1, a.f2, a.f3, a.f4, a.f5, b.y FROM zr a JOIN zr b ON b.id = a.id AND b.t = a.t + 1"),
    "pairs": (["za"], CTE["pairs"][1].replace("FROM zr a JOIN zr b", "FROM za a JOIN za b")),
}


def _increments(tag: str, edges: str, intercept: bool) -> LONG:
    """Views tag10 (all residuals, y_true), tag5 (those without neighbours) and tag_r2 (t, r2_base, r2_full)."""
    window = "OVER (PARTITION BY t)"
    columns = [*FACTORS, *NEAR]
    start = ", ".join(f"{c} - AVG({c}) {window} AS {c}" if intercept else c for c in [*columns, "y"])
    return {
        f"{tag}_row": ([edges], f"SELECT t, src, dst, w / CASE WHEN SUM(w) OVER (PARTITION BY t, src) < 1e-12 THEN 1 ELSE SUM(w) OVER (PARTITION BY t, src) END AS w FROM {edges}"),
        f"{tag}_near": _hop("za", f"{tag}_row", FACTORS, NEAR),
        f"{tag}0": (["za", f"{tag}_near"], f"SELECT t, id, y - AVG(y) {window} AS c, {start} FROM za JOIN {tag}_near USING (t, id)"),
        **_taken_out(tag, columns, "t, id, c", window),
        f"{tag}_r2": (
            [f"{tag}5", f"{tag}10"],
            f"SELECT t, COALESCE(1 - a.s / CASE WHEN a.c >= 1e-12 THEN a.c END, 0) AS r2_base, COALESCE(1 - b.s / CASE WHEN a.c >= 1e-12 THEN a.c END, 0) AS r2_full FROM (SELECT t, SUM(y*y) AS s, SUM(c*c) AS c FROM {tag}5 GROUP BY 1) a JOIN (SELECT t, SUM(y*y) AS s FROM {tag}10 GROUP BY 1) b USING (t)",
        ),
    }


def increments() -> str:
    """With and without an intercept, on the factor graph."""
    views = {**_ALIGNED, **_increments("wi", "mutual", True), **_increments("wo", "mutual", False)}
    each = " UNION ALL ".join(f"SELECT {flag} AS intercept, t, ROUND(r2_base, 6) AS r2_base, ROUND(r2_full, 6) AS r2_full, ROUND(r2_full - r2_base, 6) AS delta_r2 FROM {tag}_r2" for flag, tag in (("TRUE", "wi"), ("FALSE", "wo")))
    return sql("wi_r2", "wo_r2", last=each, **views)


def diagnosed() -> str:
    """The means over periods of four diagnostics, for the factor graph and the placebo."""
    views, each = {**_ALIGNED, **placebo("za", 10)}, []
    views["stats"] = (["za"], "SELECT t, id, y, y - AVG(y) OVER (PARTITION BY t) AS c, COUNT(*) OVER (PARTITION BY t) AS n, VAR_POP(y) OVER (PARTITION BY t) * COUNT(*) OVER (PARTITION BY t) AS zz FROM za")
    for tag, edges, scenario in (("fg", "mutual", "factor_knn"), ("pl", "placebo", "placebo")):
        views |= {
            **_increments(tag, edges, True),
            **_normal(edges, f"{tag}_gcn"),
            f"{tag}_moran": (["stats", edges], f"SELECT t, COALESCE(ANY_VALUE(a.n) / SUM(s.w) * SUM(s.w*a.c*b.c) / CASE WHEN ANY_VALUE(a.zz) >= 1e-12 THEN ANY_VALUE(a.zz) END, 0) AS moran_i FROM stats a LEFT JOIN {edges} s ON s.t = a.t AND s.src = a.id LEFT JOIN stats b ON b.t = s.t AND b.id = s.dst GROUP BY ALL".replace("SELECT t,", "SELECT a.t,")),
            f"{tag}_energy": (["za", f"{tag}_gcn"], f"SELECT t, o.s - COALESCE(x.s, 0) AS dirichlet_energy FROM (SELECT t, SUM(y*y) AS s FROM za GROUP BY 1) o LEFT JOIN (SELECT g.t, SUM(g.w*a.y*b.y) AS s FROM {tag}_gcn g JOIN za a ON a.t = g.t AND a.id = g.src JOIN za b ON b.t = g.t AND b.id = g.dst GROUP BY 1) x USING (t)"),
            f"{tag}_mean": _hop(f"{tag}5", f"{tag}_row", ["y"], ["m"]),
            f"{tag}_rest": ([f"{tag}5", f"{tag}_mean"], f"SELECT t, COALESCE(CASE WHEN SQRT(VAR_POP(y)*VAR_POP(m))*COUNT(*) >= 1e-12 THEN COVAR_POP(y, m)/SQRT(VAR_POP(y)*VAR_POP(m)) END, 0) AS residual_corr FROM {tag}5 JOIN {tag}_mean USING (t, id) GROUP BY 1"),
        }
        parts = "".join(f" JOIN {tag}_{part} USING (t)" for part in ("energy", "rest", "r2"))
        means = ", ".join(f"ROUND(AVG({c}), 6) AS {name}" for c, name in (("moran_i", "moran_i"), ("dirichlet_energy", "dirichlet_energy"), ("residual_corr", "residual_corr"), ("r2_full - r2_base", "delta_r2")))
        each.append(f"SELECT '{scenario}' AS scenario, {means} FROM {tag}_moran{parts}")
    names = [f"{tag}_{part}" for tag in ("fg", "pl") for part in ("moran", "energy", "rest", "r2")]
    return recursive(sql(*names, last=" UNION ALL ".join(each), **views))


_FIRST, _SECOND = (f"(SELECT FLOOR(MAX(t) * {part}) FROM clean)" for part in ("0.6::DOUBLE", "(0.6::DOUBLE + 0.2::DOUBLE)"))


def _ridge(tag: str, design: str, columns: list[str], alpha: float) -> LONG:
    """The view tag_pred (t, id, y_true, y_pred) of every row of the design, fitted on its training part."""
    mean = ", ".join(f"{c} - AVG(CASE WHEN t < {_FIRST} THEN {c} END) OVER () AS {c}" for c in [*columns, "y"])
    more = "".join(f" UNION ALL SELECT NULL, NULL, NULL, TRUE, {', '.join(f'SQRT({alpha}::DOUBLE)' if c == d else '0::DOUBLE' for d in columns)}, 0::DOUBLE" for c in columns)
    return {
        f"{tag}0": ([design, "clean"], f"SELECT t, id, y AS y_true, t < {_FIRST} AS fit, {mean} FROM {design}{more}"),
        **_taken_out(tag, columns, "t, id, y_true, fit", "OVER ()", "fit"),
        f"{tag}_pred": ([f"{tag}{len(columns)}"], f"SELECT t, id, y_true, y_true - y AS y_pred FROM {tag}{len(columns)} WHERE t IS NOT NULL"),
    }


HOP1, HOP2 = [f"g{i}" for i in range(1, 6)], [f"h{i}" for i in range(1, 6)]


def experiment(scenario: str, outcome: str, columns: str, placebo_graph: bool = False) -> str:
    """Raw, graph and graph-convolution models of the outcome, an expression over the cleaned panel."""
    views = {"pairs": (["clean"], CTE["pairs"][1].replace("FROM zr a JOIN zr b", "FROM clean a JOIN clean b")), **(placebo("clean", 10) if placebo_graph else {})}
    edges = "undirected" if placebo_graph else "mutual"
    views["undirected"] = (["placebo"], "SELECT t, src, dst, w/2 AS w FROM placebo UNION ALL SELECT t, dst, src, w/2 FROM placebo")
    views |= {
        "looped": ([edges, "clean"], f"SELECT t, src, dst, SUM(w) AS w FROM (SELECT t, src, dst, w FROM {edges} UNION ALL SELECT t, id, id, 1.0::DOUBLE FROM clean) GROUP BY 1, 2, 3"),
        **_normal("looped", "normal"),
        "x1": _hop("clean", "normal", FACTORS, HOP1),
        "x2": _hop("x1", "normal", HOP1, HOP2),
        "design": (["clean", "x1", "x2"], f"SELECT c.t, c.id, {', '.join(['c.' + f for f in FACTORS] + HOP1 + HOP2)}, b.y FROM clean c JOIN x1 ON x1.t = c.t AND x1.id = c.id JOIN x2 ON x2.t = c.t AND x2.id = c.id JOIN (SELECT t, id, {outcome} AS y FROM clean) b ON b.id = c.id AND b.t = c.t + 1"),
        **_ridge("raw", "design", FACTORS, 1.0),
        **_ridge("both", "design", [*FACTORS, *HOP1], 1.0),
    }
    tried = [(f"s{h}_{i}", names, alpha, f"hops={h} alpha={alpha}") for h, names in ((1, HOP1), (2, HOP2)) for i, alpha in enumerate((0.1, 10.0))]
    for tag, names, alpha, _ in tried:
        views |= _ridge(tag, "design", names, alpha)
    views["tried"] = ([f"{tag}_pred" for tag, *_ in tried], " UNION ALL ".join(f"SELECT '{name}' AS option, * FROM {tag}_pred" for tag, _, _, name in tried))
    views["losses"] = (["tried"], f"SELECT option, AVG(m) AS loss FROM (SELECT option, t, AVG((y_true-y_pred)*(y_true-y_pred)) AS m FROM tried WHERE t >= {_FIRST} AND t < {_SECOND} GROUP BY 1, 2) GROUP BY 1")
    views["pred"] = (
        ["raw_pred", "both_pred", "tried", "losses"],
        f"SELECT * FROM (SELECT 'raw' AS model, * FROM raw_pred UNION ALL SELECT 'graph', * FROM both_pred UNION ALL SELECT 'sgc', t, id, y_true, y_pred FROM tried WHERE option = (SELECT option FROM losses ORDER BY loss, option LIMIT 1)) WHERE t >= {_SECOND}",
    )
    return recursive(sql("summary", last=f"SELECT '{scenario}' AS scenario, model, {columns} FROM summary", **views))


def sweep(ks: list[int]) -> str:
    """Raw and graph models for each number of neighbours."""
    views = {
        "pairs": (["clean"], CTE["pairs"][1].replace("FROM zr a JOIN zr b", "FROM clean a JOIN clean b")),
        "knn": (["pairs"], CTE["knn"][1].replace("rank <= 10", f"rank <= {max(ks)}")),
        "plain": (["clean"], f"SELECT c.t, c.id, {', '.join('c.' + f for f in FACTORS)}, b.y FROM clean c JOIN clean b ON b.id = c.id AND b.t = c.t + 1"),
        **_ridge("raw", "plain", FACTORS, 1.0),
    }
    each = ["SELECT 'raw' AS model, * FROM raw_pred"]
    for k in ks:
        both = f"SELECT t, src, dst, w FROM rbf WHERE rank <= {k}"
        views |= {
            f"looped{k}": (["rbf", "clean"], f"SELECT t, src, dst, SUM(w) AS w FROM (SELECT t, src, dst, w/2 AS w FROM ({both}) UNION ALL SELECT t, dst, src, w/2 FROM ({both}) UNION ALL SELECT t, id, id, 1.0::DOUBLE FROM clean) GROUP BY 1, 2, 3"),
            **_normal(f"looped{k}", f"normal{k}"),
            f"near{k}": _hop("clean", f"normal{k}", FACTORS, HOP1),
            f"design{k}": (["plain", f"near{k}"], f"SELECT * FROM plain JOIN near{k} USING (t, id)"),
            **_ridge(f"k{k}_", f"design{k}", [*FACTORS, *HOP1], 1.0),
        }
        each.append(f"SELECT '{k}', * FROM k{k}__pred")
    views["pred"] = (["raw_pred", *[f"k{k}__pred" for k in ks]], f"SELECT * FROM ({' UNION ALL '.join(each)}) WHERE t >= {_SECOND}")
    views["scores"] = (["errors", "ics"], "SELECT model, r2, mean_ic FROM errors JOIN (SELECT model, AVG(ic) AS mean_ic FROM ics GROUP BY 1) USING (model)")
    values = {"raw_r2": "r.r2", "graph_r2": "g.r2", "raw_mean_ic": "r.mean_ic", "graph_mean_ic": "g.mean_ic", "delta_r2": "g.r2 - r.r2", "delta_ic": "g.mean_ic - r.mean_ic"}
    return sql("scores", last=f"SELECT CAST(g.model AS INT) AS k_neighbors, {', '.join(f'ROUND({v}, 6) AS {n}' for n, v in values.items())} FROM scores g, scores r WHERE r.model = 'raw' AND g.model <> 'raw'", **views)
