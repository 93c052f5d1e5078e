"""Model tables, differences and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import evaluate_predictions
from tessera.operators.portfolio import evaluate_portfolio


def model_summary(pred: DataFrame, bins: int = 5) -> DataFrame:
    """One row a model: metrics and portfolio results."""
    return evaluate_predictions(pred).join(evaluate_portfolio(pred, bins), "model")


def round_table(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def model_delta(summary: DataFrame, a: str, b: str) -> DataFrame:
    """metric-wise b - a; an unknown model is an error."""
    known = {r["model"] for r in summary.select("model").distinct().collect()}  # one row a model
    if not {a, b} <= known:
        raise ValueError(f"unknown model: {sorted({a, b} - known)}")
    metrics = [c for c in summary.columns if c != "model"]
    left = summary.where(F.col("model") == a).select(*[F.col(c).alias(f"_a_{c}") for c in metrics])
    right = summary.where(F.col("model") == b).select(*metrics)
    # two tables of one row
    return right.crossJoin(F.broadcast(left)).select(*[(F.col(c) - F.col(f"_a_{c}")).alias(c) for c in metrics])


def scenario_summary(table: DataFrame, models: list[str]) -> DataFrame:
    """(scenario, <model>_r2, <model>_mean_ic, ...) from one row for each scenario and model."""
    return table.groupBy("scenario").pivot("model", models).agg(F.first("r2").alias("r2"), F.first("mean_ic").alias("mean_ic"))
