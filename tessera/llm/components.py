"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each
round is two joins with per-node minima; no node's neighbours are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import dropped, stored


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and checksum, which are observed on the way."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return out, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with a link to another; root is the least node it reaches.

    Nulls, loops and repeated edges are ignored; no edge gives no row.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now, state = _written(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join is of two plain tables: a hub with a third of all links can be dealt to several tasks
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        new, after = _written(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct())
        dropped(now, least)
        now, before, state = new, state, after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
