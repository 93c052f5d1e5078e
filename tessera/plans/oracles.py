"""Shared pieces of the oracle SQL: views as common table expressions."""

FACTORS = ["f1", "f2", "f3", "f4", "f5"]


def _mean(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)/COUNT(*)"


CTE = {
    "panel": (
        [],
        f"""SELECT CAST(DENSE_RANK() OVER (ORDER BY period) - 1 AS INT) AS t, id, f1, f2, f3, f4, f5, f2 - f3 AS y FROM (
        SELECT date_trunc('month', l_shipdate) AS period, l_suppkey AS id, {_mean('l_quantity')} AS f1, {_mean('l_discount')} AS f2, {_mean('l_tax')} AS f3,
        {_mean('l_extendedprice')} AS f4, CAST(SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS DOUBLE)/COUNT(*) AS f5 FROM lineitem GROUP BY 1, 2)""",
    ),
    "grid": (
        [],
        f"""SELECT p.t, u.id, CAST(c.n AS DOUBLE) AS f1, c.avg_value AS f2, c.n_purchase AS f3, COALESCE(c.total, 0.0)/1000 AS y
        FROM (SELECT period, CAST(ROW_NUMBER() OVER (ORDER BY period) - 1 AS INT) AS t FROM (SELECT DISTINCT date_trunc('day', ts) AS period FROM events)) p
        CROSS JOIN (SELECT DISTINCT user_id AS id FROM events) u
        LEFT JOIN (SELECT date_trunc('day', ts) AS period, user_id AS id, COUNT(*) AS n, {_mean('value')} AS avg_value, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
          CAST(SUM(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS DOUBLE) AS n_purchase FROM events GROUP BY 1, 2) c ON c.period = p.period AND c.id = u.id""",
    ),
    "aligned": (["panel"], "SELECT a.t, a.id, a.f1, a.f2, a.f3, a.f4, a.f5, b.y FROM panel a JOIN panel b ON b.id = a.id AND b.t = a.t + 1"),
    "pred": (["aligned"], "SELECT 'a' AS model, t, id, y AS y_true, 0.5*f2 - 0.3*f3 AS y_pred FROM aligned UNION ALL SELECT 'b', t, id, y, f1 FROM aligned"),
    "z": (
        ["panel"],
        "SELECT t, id, y, " + ", ".join(f"({f} - AVG({f}) OVER w)/CASE WHEN STDDEV_POP({f}) OVER w < 1e-12 THEN 1 ELSE STDDEV_POP({f}) OVER w END AS {f}" for f in FACTORS) + " FROM panel WINDOW w AS (PARTITION BY t)",
    ),
    "zr": (["z"], "SELECT t, id, y, " + ", ".join(f"ROUND({f}, 6) AS {f}" for f in FACTORS) + " FROM z"),
    "zaligned": (["z"], "SELECT a.t, a.id, a.f1, a.f4, b.y FROM z a JOIN z b ON b.id = a.id AND b.t = a.t + 1"),
    "e": (["panel"], "SELECT t, src, dst, 1.0::DOUBLE AS w FROM (SELECT t, id AS src, LEAD(id) OVER (PARTITION BY t ORDER BY id) AS dst FROM panel) WHERE dst IS NOT NULL"),
    "nodes": (["panel"], "SELECT DISTINCT t, id FROM panel"),
    "sym": (["e"], "SELECT t, src, dst, SUM(w)/2 AS w FROM (SELECT * FROM e UNION ALL SELECT t, dst, src, w FROM e) GROUP BY 1, 2, 3"),
    "gcn": (
        ["sym"],
        """SELECT s.t, s.src, s.dst, s.w/SQRT(CASE WHEN a.d < 1e-12 THEN 1 ELSE a.d END * CASE WHEN COALESCE(b.d, 0) < 1e-12 THEN 1 ELSE b.d END) AS w FROM sym s
        JOIN (SELECT t, src, SUM(w) AS d FROM sym GROUP BY 1, 2) a ON a.t = s.t AND a.src = s.src LEFT JOIN (SELECT t, src, SUM(w) AS d FROM sym GROUP BY 1, 2) b ON b.t = s.t AND b.src = s.dst""",
    ),
    "pairs": (
        ["zr"],
        """SELECT a.t, a.id AS src, b.id AS dst, (a.f1-b.f1)*(a.f1-b.f1)+(a.f2-b.f2)*(a.f2-b.f2)+(a.f3-b.f3)*(a.f3-b.f3)+(a.f4-b.f4)*(a.f4-b.f4)+(a.f5-b.f5)*(a.f5-b.f5) AS score
        FROM zr a JOIN zr b ON a.t = b.t AND a.id <> b.id""",
    ),
    "knn": (["pairs"], "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY t, src ORDER BY score, dst) AS rank FROM pairs) WHERE rank <= 10"),
    "rbf": (["knn"], "SELECT t, src, dst, rank, EXP(-score) AS w FROM knn WHERE score > 0"),
    "mutual": (["rbf"], "SELECT t, src, dst, SUM(w)/2 AS w FROM (SELECT t, src, dst, w FROM rbf UNION ALL SELECT t, dst, src, w FROM rbf) GROUP BY 1, 2, 3"),
    "factor_graph": (["mutual"], "SELECT t, src, dst, w / CASE WHEN SUM(w) OVER (PARTITION BY t, src) < 1e-12 THEN 1 ELSE SUM(w) OVER (PARTITION BY t, src) END AS w FROM mutual"),
    "ranked": (["pred"], "SELECT *, ROW_NUMBER() OVER (PARTITION BY model, t ORDER BY y_pred, id) - 1 AS rank0, COUNT(*) OVER (PARTITION BY model, t) AS size FROM pred"),
    "ls": (
        ["ranked"],
        """SELECT model, t, AVG(CASE WHEN rank0 >= size - GREATEST(FLOOR(size * 0.2::DOUBLE), 1) THEN y_true END) - AVG(CASE WHEN rank0 < GREATEST(FLOOR(size * 0.2::DOUBLE), 1) THEN y_true END) AS ls
        FROM ranked GROUP BY 1, 2""",
    ),
    "groups": (["ranked"], "SELECT model, bin, AVG(ret) AS ret FROM (SELECT model, t, CAST((rank0 * 5) // size AS INT) AS bin, AVG(y_true) AS ret FROM ranked GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    "ics": (
        ["pred"],
        "SELECT model, t, COALESCE(CASE WHEN SQRT(VAR_POP(y_true)*VAR_POP(y_pred))*COUNT(*) >= 1e-12 THEN COVAR_POP(y_true, y_pred)/SQRT(VAR_POP(y_true)*VAR_POP(y_pred)) END, 0) AS ic FROM pred GROUP BY 1, 2",
    ),
    "avgranks": (
        ["pred"],
        """SELECT *, RANK() OVER (PARTITION BY model, t ORDER BY y_true) + (COUNT(*) OVER (PARTITION BY model, t, y_true) - 1)/2.0::DOUBLE AS ra,
        RANK() OVER (PARTITION BY model, t ORDER BY y_pred) + (COUNT(*) OVER (PARTITION BY model, t, y_pred) - 1)/2.0::DOUBLE AS rb FROM pred""",
    ),
    "rics": (
        ["avgranks"],
        "SELECT model, t, COALESCE(CASE WHEN SQRT(VAR_POP(ra)*VAR_POP(rb))*COUNT(*) >= 1e-12 THEN COVAR_POP(ra, rb)/SQRT(VAR_POP(ra)*VAR_POP(rb)) END, 0) AS rank_ic FROM avgranks GROUP BY 1, 2",
    ),
    "errors": (
        ["pred"],
        "SELECT model, AVG((y_true-y_pred)*(y_true-y_pred)) AS mse, AVG(ABS(y_true-y_pred)) AS mae, 1 - SUM((y_true-y_pred)*(y_true-y_pred))/(VAR_POP(y_true)*COUNT(*)) AS r2 FROM pred GROUP BY 1",
    ),
    "summary": (
        ["errors", "ics", "rics", "ls", "groups"],
        """SELECT e.model, mse, mae, r2, mean_ic, ic_ir, mean_rank_ic, rank_ic_ir, mean_ls_return, ls_sharpe, group_1_ret, group_2_ret, group_3_ret, group_4_ret, group_5_ret FROM errors e
        JOIN (SELECT model, AVG(ic) AS mean_ic, AVG(ic)/STDDEV_POP(ic) AS ic_ir FROM ics GROUP BY 1) i USING (model)
        JOIN (SELECT model, AVG(rank_ic) AS mean_rank_ic, AVG(rank_ic)/STDDEV_POP(rank_ic) AS rank_ic_ir FROM rics GROUP BY 1) r USING (model)
        JOIN (SELECT model, AVG(ls) AS mean_ls_return, AVG(ls)/STDDEV_POP(ls) AS ls_sharpe FROM ls GROUP BY 1) s USING (model)
        JOIN (SELECT model, MAX(CASE WHEN bin=0 THEN ret END) AS group_1_ret, MAX(CASE WHEN bin=1 THEN ret END) AS group_2_ret, MAX(CASE WHEN bin=2 THEN ret END) AS group_3_ret,
          MAX(CASE WHEN bin=3 THEN ret END) AS group_4_ret, MAX(CASE WHEN bin=4 THEN ret END) AS group_5_ret FROM groups GROUP BY 1) g USING (model)""",
    ),
    "near": (["panel", "sym"], "SELECT n.t, n.id, COALESCE(SUM(s.w * p.f1), 0) AS f1, COALESCE(SUM(s.w * p.f2), 0) AS f2 FROM panel n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN panel p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2"),
    "near2": (["near", "sym"], "SELECT n.t, n.id, COALESCE(SUM(s.w * p.f1), 0) AS f1, COALESCE(SUM(s.w * p.f2), 0) AS f2 FROM near n LEFT JOIN sym s ON s.t = n.t AND s.src = n.id LEFT JOIN near p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2"),
    **{
        name: ([of, "factor_graph"], "SELECT n.t, n.id, " + ", ".join(f"COALESCE(SUM(s.w * p.{f}), 0) AS {f}" for f in FACTORS) + f" FROM {of} n LEFT JOIN factor_graph s ON s.t = n.t AND s.src = n.id LEFT JOIN {of} p ON p.t = s.t AND p.id = s.dst GROUP BY 1, 2")
        for name, of in (("hop1", "zr"), ("hop2", "hop1"))
    },
    "winsor": (
        ["panel"],
        "SELECT p.t, p.id, p.y, " + ", ".join(f"LEAST(GREATEST(p.{f}, q.{f}[1]), q.{f}[2]) AS {f}" for f in FACTORS) + " FROM panel p JOIN (SELECT t, " + ", ".join(f"QUANTILE_CONT({f}, [0.01, 0.99]) AS {f}" for f in FACTORS) + " FROM panel GROUP BY t) q ON q.t = p.t",
    ),
    "clean": (
        ["winsor"],
        "SELECT t, id, y, " + ", ".join(f"({f} - AVG({f}) OVER v)/CASE WHEN STDDEV_POP({f}) OVER v < 1e-12 THEN 1 ELSE STDDEV_POP({f}) OVER v END AS {f}" for f in FACTORS) + " FROM winsor WINDOW v AS (PARTITION BY t)",
    ),
}


def sql(*names: str, last: str, **other: tuple[list[str], str]) -> str:
    """``last`` with the needed views before it, each once and in order; ``other`` views stand for those of their name."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        deps, body = other.get(name) or CTE[name]
        for d in deps:
            need(d)
        done.setdefault(name, body)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in done.items()) + " " + last if done else last
