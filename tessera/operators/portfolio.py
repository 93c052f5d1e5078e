"""Quantile and long-short portfolios from scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.guards import ratio_or_zero
from tessera.operators.ranks import positions

_KEYS = ("model", "t")


def with_ranks(pred: DataFrame) -> DataFrame:
    """Adds the 0-based rank by score (ties by id) and the period's size; a table that has them stays."""
    return pred if {"rank0", "size"} <= set(pred.columns) else positions(pred, list(_KEYS), ["y_pred", "id"])


def quantile_bins(pred: DataFrame, bins: int = 5) -> DataFrame:
    """bin = floor(rank * bins / size), ascending by score; a period of fewer rows than bins is an error (raised by the job)."""
    if bins < 2:
        raise ValueError("at least two bins are needed")
    place = F.expr(f"cast((rank0 * {bins}) div size as int)")
    return with_ranks(pred).withColumn("bin", F.when(F.col("size") >= bins, place).otherwise(F.raise_error(F.lit("a period has fewer rows than bins")).cast("int")))


def quantile_returns(pred: DataFrame, bins: int = 5) -> DataFrame:
    return quantile_bins(pred, bins).groupBy(*_KEYS, "bin").agg(F.avg("y_true").alias("ret"))


def mean_group_returns(pred: DataFrame, bins: int = 5) -> DataFrame:
    return quantile_returns(pred, bins).groupBy("model", "bin").agg(F.avg("ret").alias("ret"))


def long_short(pred: DataFrame, top: float = 0.2, bottom: float = 0.2) -> DataFrame:
    """(model, t, ls): mean of the top share less that of the bottom share, one row each at least."""
    n_top = F.greatest(F.floor(F.col("size") * F.lit(top)), F.lit(1))
    n_bottom = F.greatest(F.floor(F.col("size") * F.lit(bottom)), F.lit(1))
    high = F.avg(F.when(F.col("rank0") >= F.col("size") - n_top, F.col("y_true")))
    low = F.avg(F.when(F.col("rank0") < n_bottom, F.col("y_true")))
    return with_ranks(pred).groupBy(*_KEYS).agg((high - low).alias("ls"))


def sharpe(series: DataFrame, column: str = "ls", periods: int | None = None) -> DataFrame:
    """(model, mean_ls_return, ls_sharpe); annualised where the periods of a year are given."""
    ratio = ratio_or_zero(F.avg(column), F.stddev_pop(column))
    return series.groupBy("model").agg(F.avg(column).alias("mean_ls_return"), (ratio if periods is None else ratio * float(periods) ** 0.5).alias("ls_sharpe"))


def cumulative_returns(series: DataFrame, column: str = "ls") -> DataFrame:
    """(model, t, cum): running product of 1 + r, less 1 (losses over 100 % are allowed)."""
    upto = Window.partitionBy("model").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return series.select("model", "t", (F.product(1 + F.col(column)).over(upto) - 1).alias("cum"))


def evaluate_portfolio(pred: DataFrame, bins: int = 5) -> DataFrame:
    """One row a model: mean_ls_return, ls_sharpe and group_1_ret .. group_B_ret; the scores are ranked once."""
    pred = with_ranks(pred)
    groups = mean_group_returns(pred, bins).groupBy("model").pivot("bin", list(range(bins))).agg(F.first("ret"))
    names = groups.select("model", *[F.col(str(b)).alias(f"group_{b + 1}_ret") for b in range(bins)])
    return sharpe(long_short(pred)).join(names, "model")
