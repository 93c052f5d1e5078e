"""Linear models from distributed co-moments.

Each group is summed up by its count, means, and centred co-moments. Spark's own
aggregates merge these pairwise without ever forming sums of raw products, so a
factor whose mean is many times its deviation keeps its digits. Fits are solved
on scaled co-moments: what is a combination of other columns is told by
correlations, not by units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import dot

EPS = np.finfo(float).eps


def _sums(factors: list[str], target: str) -> list:
    """Count, means and centred co-moments (over n) of the factors and the target, as one row of columns."""
    cols = [*factors, target]
    out = [F.count(F.lit(1)).cast("double").alias("n")] + [F.avg(F.col(c)).alias(f"m_{c}") for c in cols]
    return out + [F.covar_pop(F.col(a), F.col(b)).alias(f"c_{a}__{b}") for i, a in enumerate(cols) for b in cols[i:]]


def _complete(rows: DataFrame, factors: list[str], target: str) -> DataFrame:
    """Rows without a missing value in the factors or the target."""
    present = F.lit(True)
    for c in dict.fromkeys([*factors, target]):
        present = present & F.col(c).isNotNull()
    return rows.where(present)


class CoMoments:
    """n, means m, scatter S (sums of centred products), and the target's: mean, products with the factors, own square."""

    def __init__(self, row: dict, factors: list[str], target: str):
        self.n = row["n"]

        def product(a: str, b: str) -> float:
            return self.n * (row[f"c_{a}__{b}"] if f"c_{a}__{b}" in row else row[f"c_{b}__{a}"])

        self.m = np.array([row[f"m_{f}"] for f in factors], dtype=float)
        self.S = np.array([[product(a, b) for b in factors] for a in factors], dtype=float).reshape(len(factors), len(factors))
        self.mean, self.s = float(row[f"m_{target}"]), np.array([product(f, target) for f in factors], dtype=float)
        self.yy = product(target, target)

    def only(self, at: list[int]) -> CoMoments:
        part = object.__new__(CoMoments)
        part.n, part.m, part.S, part.mean, part.s, part.yy = self.n, self.m[at], self.S[np.ix_(at, at)], self.mean, self.s[at], self.yy
        return part

    def _scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Deviations (0: the column does not vary), eigenvalues and vectors of the correlations, small ones first.

        A column's values carry a rounding error of EPS times their size; against
        the deviation that bounds what a correlation can tell, and smaller
        eigenvalues are none. A deviation of no more than that is none either.
        """
        d = np.sqrt(np.maximum(np.diag(self.S), 0.0))
        size = np.abs(self.m) * np.sqrt(self.n)
        d = np.where(d <= 8 * EPS * size, 0.0, d)
        fine = d > 0
        scale = np.where(fine, d, 1.0)
        values, vectors = np.linalg.eigh(self.S[np.ix_(fine, fine)] / np.outer(scale[fine], scale[fine]))
        noise = 16 * len(d) * EPS * max([1.0, *(size[fine] / d[fine])])
        return d, np.where(values > noise, values, 0.0), vectors

    def solve(self, alpha: float = 0.0, intercept: bool = True) -> tuple[float, np.ndarray]:
        """(intercept, beta): ridge with penalty alpha on beta, or least squares of minimum norm."""
        d, values, vectors = self._scaled()
        fine = d > 0
        scale = np.where(fine, d, 1.0)
        if alpha > 0 and intercept:
            left = self.S / np.outer(scale, scale) + alpha * np.diag(1 / scale**2)
            beta = np.linalg.solve(left, self.s / scale) / scale
            return float(self.mean - self.m @ beta), beta
        held = values > 0
        back = np.zeros((len(d), len(values)))
        back[fine] = vectors / scale[fine][:, None]
        if intercept:
            beta = back[:, held] @ ((back[:, held].T @ self.s) / values[held])
            free = np.concatenate([back[:, ~held], np.eye(len(d))[:, ~fine]], axis=1)
            return _least_norm(float(self.mean - self.m @ beta), beta, -self.m @ free, free)
        # a few rows with the same products as all rows: roots of the scatter, then the means
        root = (vectors * np.sqrt(values)).T[held] * scale[fine]
        rows = np.zeros((len(root) + 1, len(d)))
        rows[:-1, fine], rows[-1] = root, np.sqrt(self.n) * self.m
        right = np.r_[(back[:, held].T @ self.s) / np.sqrt(values[held]), np.sqrt(self.n) * self.mean]
        if alpha > 0:
            rows, right = np.vstack([rows, np.sqrt(alpha) * np.eye(len(d))]), np.r_[right, np.zeros(len(d))]
        units = np.linalg.norm(rows, axis=0)
        units = np.where(units > 0, units, 1.0)
        u, sv, vt = np.linalg.svd(rows / units, full_matrices=True)
        rank = int(np.sum(sv > max(rows.shape) * 16 * EPS * max([1e-300, *sv])))
        beta = vt[:rank].T @ ((u[:, :rank].T @ right) / sv[:rank]) / units
        free = vt[rank:].T / units[:, None]
        return 0.0, _least_norm(0.0, beta, np.zeros(free.shape[1]), free)[1]

    def r2(self, intercept: float, beta: np.ndarray) -> float:
        """Against the target's mean; 0 where the target does not vary."""
        off = self.mean - intercept - self.m @ beta
        sse = self.yy - 2 * beta @ self.s + beta @ self.S @ beta + self.n * off * off
        return 0.0 if self.yy < 1e-12 else float(1 - sse / self.yy)


def _least_norm(intercept: float, beta: np.ndarray, free_intercept: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray]:
    """The shortest of (intercept, beta) + combinations of the free directions."""
    if not free.shape[1]:
        return intercept, beta
    directions = np.vstack([free_intercept, free])
    whole = np.r_[intercept, beta]
    basis, sv, _ = np.linalg.svd(directions, full_matrices=False)
    basis = basis[:, sv > max(directions.shape) * EPS * sv[0]]
    for _ in range(2):  # once more for the digits lost in the first
        whole = whole - basis @ (basis.T @ whole)
    return float(whole[0]), whole[1:]


def moments(train: DataFrame, factors: list[str], target: str = "y") -> dict:
    """The co-moments from which any model over some of the factors is fitted: one aggregation, one row to the driver.

    Rows with a missing factor or target take no part. No row at all is an error.
    """
    row = _complete(train, factors, target).agg(*_sums(factors, target)).first().asDict()
    if not row["n"]:
        raise ValueError("no complete row to fit")
    return row


def moments_by(train: DataFrame, key: str, factors: list[str], target: str = "y") -> dict:
    """``moments`` for each value of a key with few values."""
    return {row[key]: row.asDict() for row in _complete(train, factors, target).groupBy(key).agg(*_sums(factors, target)).collect()}


def solve_ridge(sums: dict, factors: list[str], alpha: float = 1.0, target: str = "y", intercept: bool = True) -> tuple[float, list[float]]:
    """(X'X + alpha I) beta = X'y, the intercept not penalised; alpha 0 is least squares of minimum norm."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    b0, beta = CoMoments(sums, factors, target).solve(alpha, intercept)
    return b0, beta.tolist()


def fit_ridge(train: DataFrame, factors: list[str], alpha: float = 1.0, target: str = "y", intercept: bool = True) -> tuple[float, list[float]]:
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    return solve_ridge(moments(train, factors, target), factors, alpha, target, intercept)


def fit_ols(train: DataFrame, factors: list[str], target: str = "y", intercept: bool = True) -> tuple[float, list[float]]:
    return fit_ridge(train, factors, 0.0, target, intercept)


def predict_linear(df: DataFrame, factors: list[str], coef: tuple[float, list[float]], name: str = "y_pred") -> DataFrame:
    return df.withColumn(name, dot(factors, coef[1]) + coef[0])


def fit_per_period(panel: DataFrame, factors: list[str], target: str = "y", base: list[str] | None = None, intercept: bool = True) -> DataFrame:
    """One regression for each period (t, intercept, beta, r2, and r2_base over the ``base`` factors).

    Co-moments by period in one aggregation, then a small batch of solves (one row a period).
    Without an intercept it is 0, and r2 still compares with the period's mean. Rows with a
    missing factor or target take no part.
    """
    sums = _complete(panel, factors, target).groupBy("t").agg(*_sums(factors, target))
    base = factors if base is None else base

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                whole = CoMoments(row, factors, target)
                part = whole.only([factors.index(f) for f in base])
                (b0, beta), (c0, own) = whole.solve(0.0, intercept), part.solve(0.0, intercept)
                out.append((row["t"], b0, beta.tolist(), [c0, *own.tolist()], part.r2(c0, own), whole.r2(b0, beta)))
            yield pd.DataFrame(out, columns=["t", "intercept", "beta", "beta_base", "r2_base", "r2"])

    return sums.mapInPandas(run, "t int, intercept double, beta array<double>, beta_base array<double>, r2_base double, r2 double")


def residuals_per_period(panel: DataFrame, factors: list[str], target: str = "y") -> DataFrame:
    """(t, id, residual) of each period's own regression."""
    fits = fit_per_period(panel, factors, target).select("t", "intercept", "beta")
    fitted = sum((F.col(f) * F.col("beta")[i] for i, f in enumerate(factors)), F.col("intercept"))
    return panel.join(F.broadcast(fits), "t").select("t", "id", (F.col(target) - fitted).alias("residual"))


def panel_loss(pred: DataFrame) -> DataFrame:
    """(model, loss): the mean over periods of the period's mean squared error."""
    by_period = pred.groupBy("model", "t").agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)).alias("mse"))
    return by_period.groupBy("model").agg(F.avg("mse").alias("loss"))


def select_on_validation(losses: DataFrame) -> str | None:
    """The model of least loss; the first by name among equals (a few rows reach the driver)."""
    best = losses.agg(F.min(F.struct("loss", "model")).alias("b")).first()["b"]
    return best["model"] if best else None


def fit_trees(train: DataFrame, factors: list[str], kind: str = "forest", target: str = "y", trees: int | None = None, depth: int | None = None, seed: int = 42):
    """A random forest or boosted trees from Spark's own library, with the assembler before it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    assembler = VectorAssembler(inputCols=factors, outputCol="_features")
    common = {"featuresCol": "_features", "labelCol": target, "predictionCol": "y_pred", "seed": seed}
    if kind == "forest":
        model = RandomForestRegressor(numTrees=trees or 200, maxDepth=depth or 30, featureSubsetStrategy="all", **common)
    else:
        model = GBTRegressor(maxIter=trees or 300, maxDepth=depth or 4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", **common)
    return Pipeline(stages=[assembler, model]).fit(train)
