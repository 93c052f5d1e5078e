"""Cleaning, aligning and splitting panels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.guards import missing, or_one
from tessera.functions.tables import stored
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.ranks import positions

_MAX = 1.7976931348623157e308


def periods(panel: DataFrame) -> int:
    """How many periods there are (one number on the driver)."""
    last = panel.agg(F.max("t")).first()[0]
    return 0 if last is None else last + 1


def raw_features(panel: DataFrame, factors: list[str]) -> DataFrame:
    return panel.select("t", "id", *factors)


def lagged_features(panel: DataFrame, factors: list[str], lag: int = 1) -> DataFrame:
    """The features without the last ``lag`` periods."""
    total = periods(panel)
    if lag < 1 or total <= lag:
        raise ValueError("lag must be at least 1 and below the number of periods")
    return raw_features(panel, factors).where(F.col("t") < total - lag)


def align_target(panel: DataFrame, factors: list[str], lag: int = 1, target: str = "y") -> DataFrame:
    """Features at t with the target at t + lag, by period number (gaps stay gaps)."""
    if lag < 1:
        raise ValueError("lag must be at least 1")
    later = panel.select((F.col("t") - lag).alias("t"), "id", F.col(target).alias("_y"))
    return panel.select("t", "id", *factors).join(later, ["t", "id"]).withColumnRenamed("_y", target)


def flatten_panel(panel: DataFrame, factors: list[str], target: str = "y") -> DataFrame:
    """The rows as a learner takes them: ``row`` numbers them by period, then entity, from 0; then the factors and the target."""
    whole = positions(panel.select("t", "id", *factors, target).withColumn("_all", F.lit(0)), ["_all"], ["t", "id"])
    return whole.select(F.col("rank0").cast("long").alias("row"), *factors, target)


def raw_dataset(panel: DataFrame, factors: list[str], lag: int = 1, flatten: bool = True, target: str = "y") -> DataFrame:
    """Factors aligned with the later target; flattened, or as a panel."""
    aligned = align_target(panel, factors, lag, target)
    return flatten_panel(aligned, factors, target) if flatten else aligned


def align_graph(edges: DataFrame, total: int, lag: int = 1) -> DataFrame:
    """The graph has the features' date: its last ``lag`` periods go."""
    return edges.where(F.col("t") < total - lag)


def split_points(total: int, train: float, valid: float, test: float) -> tuple[int, int]:
    if not math.isclose(train + valid + test, 1.0):
        raise ValueError("the shares must sum to 1")
    if min(train, valid, test) <= 0:
        raise ValueError("the shares must be positive")
    first, second = int(total * train), int(total * (train + valid))
    if not 0 < first < second < total:
        raise ValueError("a part would be empty")
    return first, second


def time_split(df: DataFrame, total: int, train: float = 0.6, valid: float = 0.2, test: float = 0.2) -> DataFrame:
    """Adds ``part``: train, valid or test, by period."""
    first, second = split_points(total, train, valid, test)
    return df.withColumn("part", F.when(F.col("t") < first, "train").when(F.col("t") < second, "valid").otherwise("test"))


def fillna_zero(panel: DataFrame, factors: list[str]) -> DataFrame:
    """Missing values become 0, infinite ones the largest finite."""
    def filled(f: str):
        c = missing(F.col(f))
        return F.when(c.isNull(), 0.0).when(c == math.inf, _MAX).when(c == -math.inf, -_MAX).otherwise(c)

    return panel.withColumns({f: filled(f) for f in factors})


def fillna_mean(panel: DataFrame, factors: list[str]) -> DataFrame:
    """Missing values become the factor's mean over all periods; a factor without values stays null."""
    means = panel.agg(*[F.avg(missing(F.col(f))).alias(f"_m_{f}") for f in factors])  # one row
    both = panel.crossJoin(F.broadcast(means))
    return both.withColumns({f: F.coalesce(missing(F.col(f)), F.col(f"_m_{f}")) for f in factors}).select(panel.columns)


def _scaled(joined: DataFrame, factors: list[str], columns: list[str]) -> DataFrame:
    return joined.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / or_one(F.col(f"_s_{f}")) for f in factors}).select(columns)


def _moments(factors: list[str]) -> list:
    return [x for f in factors for x in (F.avg(missing(F.col(f))).alias(f"_m_{f}"), F.stddev_pop(missing(F.col(f))).alias(f"_s_{f}"))]


def zscore_cs(panel: DataFrame, factors: list[str]) -> DataFrame:
    """Per period: (x - mean) / population deviation; a deviation near 0 counts as 1.

    The statistics are one row for each period (a calendar's length) and are broadcast, so no task holds a period.
    """
    return _scaled(panel.join(F.broadcast(panel.groupBy("t").agg(*_moments(factors))), "t"), factors, panel.columns)


def zscore_global(panel: DataFrame, factors: list[str]) -> DataFrame:
    return _scaled(panel.crossJoin(F.broadcast(panel.agg(*_moments(factors)))), factors, panel.columns)


def winsorize_cs(panel: DataFrame, factors: list[str], lower: float = 0.01, upper: float = 0.99, path: str = "select") -> DataFrame:
    """Per period: clips to two quantiles, linear between values.

    ``path="select"`` finds them in passes of counts and reads the panel five times besides
    (it is stored first): no task holds a period. ``"sort"`` keeps a period's different values in one aggregate,
    ``"approximate"`` does so with a sketch. The limits, one row a period, are broadcast.
    """
    if not 0 <= lower < upper <= 1:
        raise ValueError("quantiles must satisfy 0 <= lower < upper <= 1")
    aggregates = {"sort": "percentile", "approximate": "percentile_approx"}
    if path == "select":
        panel = stored(panel, "winsorize")
        limits = exact_quantiles(panel, factors, [lower, upper])
    elif path in aggregates:
        limits = panel.groupBy("t").agg(*[F.expr(f"{aggregates[path]}(nanvl({f}, null), array({lower}D, {upper}D))").alias(f) for f in factors])
    else:
        raise ValueError("path must be select, sort or approximate")
    both = panel.join(F.broadcast(limits.select("t", *[F.col(f).alias(f"_q_{f}") for f in factors])), "t")
    return both.withColumns({f: F.least(F.greatest(F.col(f), F.col(f"_q_{f}")[0]), F.col(f"_q_{f}")[1]) for f in factors}).select(panel.columns)


def preprocess_panel(
    panel: DataFrame, factors: list[str], fill: str | None = "zero", winsorize: bool = True, lower: float = 0.01, upper: float = 0.99, zscore: str | None = "cross_section"
) -> DataFrame:
    """Fill, winsorize, z-score; each step can be left out."""
    fills = {"zero": fillna_zero, "mean": fillna_mean}
    scores = {"cross_section": zscore_cs, "global": zscore_global}
    if fill is not None:
        panel = fills[fill](panel, factors)
    if winsorize:
        panel = winsorize_cs(panel, factors, lower, upper)
    return panel if zscore is None else scores[zscore](panel, factors)
