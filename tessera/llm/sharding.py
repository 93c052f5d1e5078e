"""Sharding by proportional stratified interleaving, in DataFrame operations.

Every source's rows are shuffled by a seeded hash and ranked; a row's
fractional rank ``(rank - 0.5) / rows of the source`` spreads each source evenly
over [0, 1). Sorting all rows by it interleaves the sources in proportion, so
that any contiguous cut of the order has the mixture of the whole.

The law is ``rows``: the counts of the shards differ by one at most. Rows are
cut one by one, so equal texts are not held together (a group of copies may be
larger than a shard); callers who need that shard representatives only.

No window ever holds one source or the whole table: ranks are taken inside
ranges of the hash (or of the fractional rank) and shifted by the counts of the
ranges before, so a source with a third of all rows is as many small groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, stored, whole_text


def _before(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``before``: rows in the ranges that precede, and ``total``, inside ``keys``."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({
        "before": F.coalesce(F.sum("rows").over(upto), F.lit(0)),
        "total": F.sum("rows").over(group),
    })


def interleave(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 20240607,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    rows_each: int = 20_000,
) -> DataFrame:
    """One row for each row of ``docs``: shard, slot, size and checksum.

    Null text: size 1, the checksum of the empty text. Null sources form one
    source. Null or repeated ids and repeated rows are ordinary rows; rows equal
    in id, source and text are interchangeable. An empty table gives no row.
    Other columns of ``docs`` are ignored.

    Returns doc_id, source, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    base = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col))).alias("_src"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")),
        "shard-base",
    )
    rows = base.count()
    n = buckets_for(spark, rows, rows_each)
    base = base.withColumn("_b", F.floor((F.col("_h").cast("double") / F.lit(2.0**64) + 0.5) * n))

    in_source = _before(base.groupBy("_src", "_b").agg(F.count(F.lit(1)).alias("rows")), ["_src"], "_b")
    local = Window.partitionBy("_src", "_b").orderBy("_h", "doc_id", "text_crc32", "size")
    ranked = (
        base.withColumn("_r", F.row_number().over(local))
        .join(in_source, ["_src", "_b"])
        .withColumn("_f", (F.col("_r") + F.col("before") - 0.5) / F.col("total"))
        .select("doc_id", "source", "size", "text_crc32", "_src", "_h", "_f")
    )
    ranked = stored(ranked, "shard-ranks").withColumn("_c", F.floor(F.col("_f") * n))

    overall = _before(ranked.groupBy("_c").agg(F.count(F.lit(1)).alias("rows")), [], "_c").select("_c", "before")
    local = Window.partitionBy("_c").orderBy("_f", "_src", "_h", "doc_id", "text_crc32", "size")
    placed = (
        ranked.withColumn("_r", F.row_number().over(local))
        .join(overall, "_c")
        .withColumn("_pos", F.col("_r") - 1 + F.col("before"))
        .withColumn("_shard", F.expr(f"(_pos * {n_shards}) div {max(rows, 1)}"))
    )
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_pos - (_shard * {rows} + {n_shards - 1}) div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
