"""Ranks inside groups of any size, from one range-partitioned sort.

All rows are sorted at once by (keys, order) into ranges, so a period with most
of the rows, or a value that most rows share, is spread over as many tasks as it
fills. A row's place in its range, the sum of the ranges before (one number
each) and its group's first place give its rank; no window holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tables import stored


def positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank0`` (from 0, by ``order``, nulls first) and ``size`` inside ``keys`` (not null, few groups).

    Rows equal in ``order`` get different ranks; which is left open.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    kept = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranks").withColumn("_part", F.shiftrightunsigned("_at", 33))
    ranges = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, one row each
    bases = ranges.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = kept.join(F.broadcast(bases), "_part").withColumn("_place", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    groups = placed.groupBy(*keys).agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("size"))
    ranked = placed.join(F.broadcast(groups), keys)
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_place") - F.col("_start")).alias("rank0"), "size")


def average_ranks(df: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """Adds 1-based ranks by ``column``; equal values (also over borders of ranges) share the mean of their places."""
    ranked = positions(df, keys, [column])
    ties = ranked.groupBy(*keys, F.col(column).alias("_value")).agg(F.min("rank0").alias("_first"), F.count(F.lit(1)).alias("_same"))
    ties = ties.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_value", (F.col("_first") + 1 + (F.col("_same") - 1) / F.lit(2.0)).alias("_rank"))
    equal = F.col(column).eqNullSafe(F.col("_value"))
    for i, k in enumerate(keys):
        equal = equal & (F.col(k) == F.col(f"_{i}"))
    return ranked.join(ties, equal).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_rank").alias(name))
