"""Neighbour aggregation over one graph for all periods (edges src, dst, w without a period).

An entity's whole history is one row: a matrix of periods x columns, and which
periods it has. The edges are dealt by target once and stay there. Each hop
joins them with the histories where they lie, adds weighted histories up for
each source inside the task, and only these sums move, to the source's place,
which is where the next hop finds them. Edges are neither copied for the periods
nor shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds in sums before it hands them on.
HELD = 4_000_000
VECTOR = "id long, v array<double>"


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def histories(panel: DataFrame, columns: list[str], total: int) -> DataFrame:
    """(id, present, v): for each entity which of the periods 0 .. total - 1 it has, and its columns, period by period (0 where absent or missing)."""
    cells = F.struct(F.col("t").cast("int").alias("t"), F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in columns]).alias("x"))
    # a list has an element for each period of an entity at most
    lists = panel.repartition(_parts(panel), "id").groupBy("id").agg(F.collect_list(cells).alias("cells"))
    width = len(columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cells = batch.column("cells")
            n = batch.num_rows
            owner = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
            flat = cells.flatten()
            t = flat.field("t").to_numpy()
            x = flat.field("x").flatten().to_numpy().reshape(-1, width)
            present, v = np.zeros((n, total), bool), np.zeros((n, total, width))
            present[owner, t], v[owner, t] = True, x
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(present, pa.array(present.ravel())), _lists(v, pa.array(v.ravel()))], names=["id", "present", "v"])

    return lists.mapInArrow(run, "id long, present array<boolean>, v array<double>")


def _lists(rows: np.ndarray, flat):
    import pyarrow as pa

    each = rows.size // max(1, len(rows))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(each)), flat)


def by_target(edges: DataFrame) -> DataFrame:
    """The edges where their targets' histories are."""
    return edges.select("src", F.col("dst").alias("id"), "w").repartition(_parts(edges), "id")


def hop(vectors: DataFrame, dealt: DataFrame, size: int) -> DataFrame:
    """(id, present, v): for each entity the weighted sum of its neighbours' v in every period it has (0 without neighbours)."""
    meeting = dealt.join(vectors.select("id", "v"), "id").select("src", "w", "v")

    def partial(batches: Iterator) -> Iterator:
        """The sums that the task's edges give each source."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            src = batch.column("src").to_numpy()
            v = batch.column("v").flatten().to_numpy().reshape(-1, size) * batch.column("w").to_numpy()[:, None]
            order = np.argsort(src, kind="stable")
            starts = np.flatnonzero(np.r_[True, src[order][1:] != src[order][:-1]])
            for s, own in zip(src[order][starts].tolist(), np.add.reduceat(v[order], starts, axis=0), strict=True):
                held[s] = held[s] + own if s in held else own
            if len(held) * size > HELD:
                yield from _handed(held)
                held.clear()
        yield from _handed(held)

    def whole(batches: Iterator) -> Iterator:
        """Sums of one source follow each other."""
        last, total = None, None
        for batch in batches:
            out = {}
            for s, own in zip(batch.column("id").to_pylist(), batch.column("v").flatten().to_numpy().reshape(-1, size), strict=True):
                if s == last:
                    total = total + own
                else:
                    if last is not None:
                        out[last] = total
                    last, total = s, own
            yield from _handed(out)
        if last is not None:
            yield from _handed({last: total})

    def _handed(sums: dict[int, np.ndarray]) -> Iterator:
        import pyarrow as pa

        ids = list(sums)
        for lo in range(0, len(ids), step):
            own = ids[lo : lo + step]
            rows = np.stack([sums[i] for i in own])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), _lists(rows, pa.array(rows.ravel()))], names=["id", "v"])

    step = max(1, 1_000_000 // size)
    sums = meeting.mapInArrow(partial, VECTOR).repartition(_parts(vectors), "id").sortWithinPartitions("id").mapInArrow(whole, VECTOR)
    # a source has one sum; grouping by id keeps its place known to the join, without a shuffle
    sums = sums.repartition(_parts(vectors), "id").select("id", F.col("v").alias("_sum"))
    periods = F.size("present")
    masked = F.transform("_sum", lambda x, i: F.when(F.get("present", F.floor(i / (F.size("_sum") / periods)).cast("int")), x).otherwise(F.lit(0.0)))
    return vectors.select("id", "present").join(sums, "id", "left").select("id", "present", F.coalesce(masked, F.array_repeat(F.lit(0.0), F.lit(size))).alias("v"))


def rows_of(vectors: DataFrame, names: list[str]) -> DataFrame:
    """(t, id, names...): a row for each entity and period it has."""
    width = len(names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            present = np.asarray(batch.column("present").flatten().to_numpy(zero_copy_only=False), bool).reshape(batch.num_rows, -1)
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1, width)
            i, t = np.nonzero(present)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), batch.column("id").take(pa.array(i)), *[pa.array(v[i, t, k]) for k in range(width)]], names=["t", "id", *names])

    quoted = ", ".join(f"`{n.replace('`', '``')}` double" for n in names)
    return vectors.select("id", "present", "v").mapInArrow(run, f"t int, id long, {quoted}")


def hops_of(panel: DataFrame, edges: DataFrame, columns: list[str], hops: int, total: int) -> list[DataFrame]:
    """The histories after each of the hops."""
    out, vectors, dealt = [], histories(panel, columns, total), by_target(edges)
    for _ in range(hops):
        vectors = hop(vectors, dealt, total * len(columns))
        out.append(vectors)
    return out
