"""Algebra of edge tables (t, src, dst, w); a missing row is a zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.guards import or_one

KEY = ["t", "src", "dst"]


def nodes_of(panel: DataFrame) -> DataFrame:
    return panel.select("t", "id").distinct()


def _summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*KEY).agg(F.sum("w").alias("w"))


def add_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    loops = nodes.select("t", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(fill)).alias("w"))
    return _summed(edges.select(*KEY, "w").unionAll(loops))


def degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row sums (t, id, d); 0 for nodes without edges."""
    sums = edges.groupBy("t", F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    return nodes.join(sums, ["t", "id"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))


def _row_sums(edges: DataFrame) -> DataFrame:
    return edges.groupBy("t", "src").agg(F.sum("w").alias("d"))


def _with_row_sums(edges: DataFrame) -> DataFrame:
    """Adds d, the sum of the source's row. A window reads the edges once, where a join with the sums would compute them twice."""
    return edges.withColumn("d", F.sum("w").over(Window.partitionBy("t", "src")))


def row_normalize(edges: DataFrame) -> DataFrame:
    return _with_row_sums(edges.select(*KEY, "w")).select(*KEY, (F.col("w") / or_one(F.col("d"))).alias("w"))


def gcn_normalize(edges: DataFrame) -> DataFrame:
    """w / sqrt(d_src * d_dst), row sums at both ends."""
    far = _row_sums(edges).select("t", F.col("src").alias("dst"), F.col("d").alias("e"))
    both = _with_row_sums(edges.select(*KEY, "w")).join(far, ["t", "dst"], "left")
    return both.select(*KEY, (F.col("w") / F.sqrt(or_one(F.col("d")) * or_one(F.coalesce("e", F.lit(0.0))))).alias("w"))


def symmetrize(edges: DataFrame, method: str = "mean") -> DataFrame:
    """The mean, or the greater, of both directions; a missing direction is 0.

    Both directions come from one scan, dealt by source, so that sums of a source's row need no other shuffle.
    """
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    both = edges.select("t", F.explode(ends).alias("e"), "w").select("t", F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "w")
    groups = both.repartition("t", "src").groupBy(*KEY)
    if method == "mean":
        return groups.agg((F.sum("w") / 2).alias("w"))
    if method != "max":
        raise ValueError("method must be mean or max")
    greatest = groups.agg(F.when(F.count(F.lit(1)) == 1, F.greatest(F.max("w"), F.lit(0.0))).otherwise(F.max("w")).alias("w"))
    return greatest.where("w <> 0")


def laplacian(edges: DataFrame, nodes: DataFrame, normalized: bool = True) -> DataFrame:
    """D - A, or I - D^-1/2 A D^-1/2 (a node without edges has 1 on the diagonal)."""
    if normalized:
        rows = gcn_normalize(edges)
        diagonal = nodes.select("t", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    else:
        rows = edges
        diagonal = degree(edges, nodes).select("t", F.col("id").alias("src"), F.col("id").alias("dst"), F.col("d").alias("w"))
    return _summed(diagonal.unionAll(rows.select(*KEY, (-F.col("w")).alias("w"))))


def ensure_nonnegative(edges: DataFrame) -> DataFrame:
    return edges.where("w > 0")


def finished(edges: DataFrame, nodes: DataFrame, symmetric: bool = True, self_loop: bool = False, row_norm: bool = True, gcn_norm: bool = False) -> DataFrame:
    """The switchable last steps of every graph builder, in their fixed order."""
    if symmetric:
        edges = symmetrize(edges)
    if self_loop:
        edges = add_self_loops(edges, nodes)
    if gcn_norm:
        return gcn_normalize(edges)
    return row_normalize(edges) if row_norm else edges
