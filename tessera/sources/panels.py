"""Panels from fact tables, and sinks for results.

A panel has one row for each (t, id): t a dense period number from 0, id the
entity, f1..fK the factors, y the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_period_number(df: DataFrame, period: str = "period", t: str = "t") -> DataFrame:
    """Adds the dense number of the period.

    The numbers come from the distinct periods, one row each (a calendar's
    length), so no window sees the table itself.
    """
    days = df.select(period).distinct()
    numbered = days.withColumn(t, (F.row_number().over(Window.orderBy(period)) - 1).cast("int"))
    return df.join(numbered, period).drop(period)


def _mean(column: str, kind: str = "decimal(18,2)"):
    # exact sums: their order cannot change the result
    return F.sum(F.col(column).cast(kind)).cast("double") / F.count(F.lit(1))


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by month, five factors and the discount-tax spread as target; unbalanced."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.date_trunc("month", "l_shipdate").alias("period"), F.col("l_suppkey").alias("id"), "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag"
    )
    cells = rows.groupBy("period", "id").agg(
        _mean("l_quantity").alias("f1"),
        _mean("l_discount").alias("f2"),
        _mean("l_tax").alias("f3"),
        _mean("l_extendedprice").alias("f4"),
        (F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double") / F.count(F.lit(1))).alias("f5"),
    )
    return with_period_number(cells.withColumn("y", F.col("f2") - F.col("f3"))).select("t", "id", "f1", "f2", "f3", "f4", "f5", "y")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day on a gap-free grid; factors are null where a user did nothing."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("period"), F.col("user_id").alias("id"), "value", "event_type")
    cells = events.groupBy("period", "id").agg(
        F.count(F.lit(1)).cast("double").alias("f1"),
        _mean("value").alias("f2"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("double").alias("f3"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
    )
    # the grid is the definition of a balanced panel: every day for every user
    days = events.select("period").distinct()
    # (the days are a calendar's length)
    grid = events.select("id").distinct().crossJoin(F.broadcast(days))
    full = grid.join(cells, ["period", "id"], "left").withColumn("y", F.coalesce("total", F.lit(0.0)) / 1000)
    return with_period_number(full).select("t", "id", "f1", "f2", "f3", "y")


def embedding_section(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """One cross-section from ``embeddings``: a column for each dimension of its first row."""
    df = table(spark, sf_dir, "embeddings")
    first = df.select(F.size("embedding").alias("n")).first()
    names = [f"e{i}" for i in range(first["n"] if first else 1)]
    cols = [F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(names)]
    return df.select(F.lit(0).alias("t"), F.col("vec_id").alias("id"), F.col("label").alias("group_id"), *cols), names


def predictions(panel: DataFrame) -> DataFrame:
    """Two scores without a fit, at t, beside the outcome at t + 1 (model, t, id, y_true, y_pred)."""
    from tessera.operators.panel import align_target

    aligned = align_target(panel, ["f1", "f2", "f3"])
    models = F.array(
        F.struct(F.lit("a").alias("model"), (0.5 * F.col("f2") - 0.3 * F.col("f3")).alias("y_pred")),
        F.struct(F.lit("b").alias("model"), F.col("f1").alias("y_pred")),
    )
    return aligned.select("t", "id", F.col("y").alias("y_true"), F.explode(models).alias("m")).select("m.model", "t", "id", "y_true", "m.y_pred")


def ring(panel: DataFrame) -> DataFrame:
    """In each period every entity points to the one with the next id (t, src, dst, w)."""
    order = Window.partitionBy("t").orderBy("id")
    linked = panel.select("t", F.col("id").alias("src"), F.lead("id").over(order).alias("dst"))
    return linked.where("dst is not null").withColumn("w", F.lit(1.0))


def nation_graph(spark: SparkSession, sf_dir: str, reach: int = 30) -> DataFrame:
    """One graph for all periods (src, dst, w): suppliers of a nation whose numbers are d <= ``reach`` apart, weight 1 / d, from the lower to the higher."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    steps = own.select(F.col("id").alias("src"), "nation", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("d"))
    far = own.select(F.col("id").alias("dst"), "nation")
    return steps.withColumn("dst", F.col("src") + F.col("d")).join(far, ["dst", "nation"]).select("src", "dst", (F.lit(1.0) / F.col("d")).alias("w"))


def save_summary_csv(df: DataFrame, path: str) -> str:
    """Writes a small result table as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def save_panel_graph(panel: DataFrame, edges: DataFrame, path: str) -> str:
    """Writes panel and edges as Parquet, partitioned by period."""
    panel.write.mode("overwrite").partitionBy("t").parquet(f"{path}/panel")
    edges.write.mode("overwrite").partitionBy("t").parquet(f"{path}/edges")
    return path
