"""Prediction metrics over (model, t, id, y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.guards import correlation, ratio_or_zero
from tessera.operators.ranks import average_ranks


def pooled_errors(pred: DataFrame) -> DataFrame:
    """(model, mse, mae, r2) over all rows; r2 is 0 where the outcome does not vary."""
    error = F.col("y_true") - F.col("y_pred")
    sst = F.var_pop("y_true") * F.count(F.lit(1))
    return pred.groupBy("model").agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("_sse"), sst.alias("_sst")).select(
        "model", "mse", "mae", F.when(F.col("_sst") < 1e-12, 0.0).otherwise(1 - F.col("_sse") / F.when(F.col("_sst") >= 1e-12, F.col("_sst"))).alias("r2")
    )


def ic(pred: DataFrame, x: str = "y_true", y: str = "y_pred") -> DataFrame:
    """(model, t, ic): each period's Pearson correlation, 0 where a side does not vary."""
    return pred.groupBy("model", "t").agg(correlation(x, y).alias("ic"))


def with_average_rank(df: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """1-based ranks; equal values share the mean of their places."""
    return average_ranks(df, column, name, keys)


def rank_ic(pred: DataFrame) -> DataFrame:
    keys = ["model", "t"]
    both = with_average_rank(with_average_rank(pred, "y_true", "_ra", keys), "y_pred", "_rb", keys)
    return ic(both, "_ra", "_rb").withColumnRenamed("ic", "rank_ic")


def ic_ir(series: DataFrame, column: str) -> DataFrame:
    """(model, mean_x, x_ir): mean, and mean over population deviation."""
    return series.groupBy("model").agg(F.avg(column).alias(f"mean_{column}"), ratio_or_zero(F.avg(column), F.stddev_pop(column)).alias(f"{column}_ir"))


def evaluate_predictions(pred: DataFrame) -> DataFrame:
    """One row a model: mse, mae, r2, mean_ic, ic_ir, mean_rank_ic, rank_ic_ir."""
    return pooled_errors(pred).join(ic_ir(ic(pred), "ic"), "model").join(ic_ir(rank_ic(pred), "rank_ic"), "model")
