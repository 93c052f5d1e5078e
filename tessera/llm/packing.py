"""Packing token sequences by minimum bin slack.

Each document is tokenised once; windows it fills alone are cut off, and what
remains (fewer tokens than a window) is packed. Only the histogram of remaining
lengths, at most one count for each length, decides the packing: a bitset
subset-sum dynamic programme finds the multiset of remaining lengths that fills
a window closest to its capacity, the counts are traced back, and the pattern is
used as often as the counts allow. Each pattern uses up a length or so, so there
are about as many patterns as lengths, however many documents there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, stored
from tessera.llm.tokens import encoder, in_batches

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def tokenized_pieces(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document: full windows, then the rest."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path).encode
        for batch in batches:
            at = 0
            for texts in in_batches(batch.column("text").to_pylist(), 1_000_000):
                own, out = [], []
                for i, data in enumerate(encode(texts), at):
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, window):
                        piece = data[4 * start : 4 * (start + window)]
                        own.append(i)
                        out.append((start, len(piece) // 4, zlib.crc32(piece), n))
                at += len(texts)
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), *columns], names=NAMES)

    return rows.mapInArrow(run, PIECE)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset from ``counts`` whose sum is closest to ``capacity`` from below.

    The longest length is always taken (else it may be left over to the end).
    The reachable sums are the set bits of an integer; a length's copies enter in
    binary parts, and the bitset before each part serves to trace back.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            part *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    used = {longest: 1}
    for length, take, before in reversed(steps):
        if before >> at & 1:
            continue
        used[length] = used.get(length, 0) + take
        at -= length * take
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, pattern) until every counted length is used."""
    counts = {k: v for k, v in histogram.items() if v}
    plan = []
    while counts:
        pattern = best_fill(counts, capacity)
        times = min(counts[k] // n for k, n in pattern.items())
        plan.append((times, pattern))
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return plan


def pack(
    docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 20_000
) -> DataFrame:
    """Every token of every document in exactly one piece, pieces in windows.

    Null and empty texts are the end id alone. Rows with null or repeated ids are
    packed like any other. An empty table gives no row; other columns are
    ignored. The driver holds one count for each length below ``window``.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, path, window, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    n = buckets_for(spark, total, rows_each)

    # a rank inside each length: ranges of a hash are ranked by themselves and shifted
    hashed = pieces.withColumn("_h", F.xxhash64("doc_id", "start", "ids_crc32"))
    hashed = hashed.withColumn("_b", F.pmod("_h", F.lit(n)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = hashed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    order = Window.partitionBy("length", "_b").orderBy("_h", "doc_id", "start")
    ranked = (
        hashed.withColumn("_r", F.row_number().over(order) - 1)
        .join(shifts, ["length", "_b"])
        .withColumn("_rank", (F.col("_r") + F.col("_before")).cast("long"))
        .drop("_b", "_h", "_r", "_before")
    )

    # for each length, the ranks at which its uses in the patterns begin
    uses: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken = dict.fromkeys(counts, 0)
    first = 0
    for times, pattern in plan_windows(counts, window):
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            uses.setdefault(length, []).append((taken[length], each, first, offset, length))
            taken[length] += each * times
            offset += each * length
        first += times
    table = {k: np.array(v, dtype=np.int64) for k, v in uses.items()}
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sequence, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            for length in np.unique(lengths):
                own, rows = shared.value[int(length)], lengths == length
                use = own[np.searchsorted(own[:, 0], ranks[rows], side="right") - 1]
                k = ranks[rows] - use[:, 0]
                sequence[rows] = use[:, 2] + k // use[:, 1]
                offset[rows] = use[:, 3] + k % use[:, 1] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in NAMES], pa.array(sequence), pa.array(offset)], names=[*NAMES, "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInArrow(place, PIECE + ", sequence_id long, offset long")
