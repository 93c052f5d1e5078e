"""Exact quantiles inside periods of any size, by selection instead of sorting.

The 64 bits of a double, with the sign folded in, order as the double does. Each of
four passes counts the values of every period and column by the next 16 bits of that
image, among those that share the bits found so far; the count into which the wanted
place falls gives the next 16 bits. A task holds counts, never values, and hands on
at most 65,536 of them for each wanted place, so neither a period with most of the
rows nor a value that most rows share is gathered anywhere.

On the driver are the wanted places alone: two for each period, column and quantile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DIGIT = 16
_SIGN = np.uint64(1 << 63)
#: Counts that a task merges before it hands them on.
_HELD = 1 << 20


def image(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers that order as the doubles do; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def preimage(u: np.ndarray) -> np.ndarray:
    return np.where(u & _SIGN, u & ~_SIGN, ~u).view(np.float64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(key), dtype=np.int64)
    np.add.at(n, at, np.concatenate(counts))
    return key, n


def _counted(panel: DataFrame, columns: list[str], times: np.ndarray, found: np.ndarray, step: int) -> DataFrame:
    """(key, n): how many values of a column and period go on with each digit after the bits of a wanted place.

    ``found`` has the bits by (column, period, place); the first place of equal bits counts for
    all. A key is ((column * periods + period) * places + place) * 2^16 + digit.
    """
    held = panel.sparkSession.sparkContext.broadcast((times, found))
    shift = np.uint64(64 - _DIGIT * (step + 1))
    places = found.shape[2]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        times, found = held.value
        keys, counts, size = [], [], 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], names=["key", "n"])

        for batch in batches:
            at = np.searchsorted(times, batch.column(0).to_numpy(zero_copy_only=False))
            for c in range(len(columns)):
                x = batch.column(c + 1).to_numpy(zero_copy_only=False).astype(np.float64)
                here = np.flatnonzero(~np.isnan(x))
                u, t = image(x[here]), at[here]
                before = u >> (shift + np.uint64(_DIGIT)) if step else np.zeros_like(u)
                same = before[:, None] == found[c][t]
                slot, wanted = same.argmax(axis=1), same.any(axis=1)
                digit = ((u >> shift) & np.uint64(2**_DIGIT - 1)).astype(np.int64)
                key = ((c * len(times) + t) * places + slot) * 2**_DIGIT + digit
                key, n = np.unique(key[wanted], return_counts=True)
                keys.append(key)
                counts.append(n)
                size += len(key)
            if size > 2 * _HELD:
                key, n = _merged(keys, counts)
                keys, counts, size = [key], [n], len(key)
                if size > _HELD:
                    yield handed()
                    keys, counts, size = [], [], 0
        if keys:
            key, n = _merged(keys, counts)
            keys, counts = [key], [n]
            yield handed()

    rows = panel.where(F.col("t").isNotNull()).select(F.col("t").cast("long"), *[F.col(c).cast("double") for c in columns])
    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _reached(counts: DataFrame) -> DataFrame:
    """(wanted, digit, upto, n): each count with the sum up to it; a window holds one wanted place's counts, 65,536 at most."""
    digits = counts.select(F.shiftright("key", _DIGIT).alias("wanted"), F.col("key").bitwiseAND(F.lit(2**_DIGIT - 1)).alias("digit"), "n")
    return digits.withColumn("upto", F.sum("n").over(Window.partitionBy("wanted").orderBy("digit")))


def exact_quantiles(panel: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(t, one array<double> for each column): the quantiles of each period, linear between neighbouring values.

    Missing values (null, NaN) take no part; a column without a value in a period
    gives null. Rows without a period take no part. The panel is read five times (once for
    its periods alone), so what is costly to make should be stored before.
    """
    if not shares or not all(0 <= q <= 1 for q in shares):
        raise ValueError("quantiles must be between 0 and 1")
    if len(set(columns)) != len(columns) or "t" in columns:
        raise ValueError("columns must be different, and none the period")
    spark = panel.sparkSession
    schema = f"t {panel.schema['t'].dataType.simpleString()}"
    times = np.array(sorted(r[0] for r in panel.select("t").distinct().collect() if r[0] is not None), dtype=np.int64)
    places = 2 * len(shares)
    shape = (len(columns), len(times), places)
    found, size = np.zeros(shape, dtype=np.uint64), np.zeros(shape[:2], dtype=np.int64)
    rest, position = np.zeros(shape, dtype=np.int64), np.zeros((*shape[:2], len(shares)))
    for step in range(64 // _DIGIT if found.size else 0):
        first = (found[..., :, None] == found[..., None, :]).argmax(axis=-1)  # the place that counts for all of equal bits
        wanted = np.arange(len(columns) * len(times)).reshape(*shape[:2], 1) * places + first
        reached = _reached(_counted(panel, columns, times, found, step))
        if step == 0:
            reached = reached.persist()
            totals = reached.groupBy("wanted").agg(F.max("upto").alias("n")).toPandas()
            size.reshape(-1)[totals["wanted"].to_numpy(np.int64) // places] = totals["n"].to_numpy(np.int64)
            position = np.maximum(size - 1, 0)[..., None] * np.array(shares)
            rest[..., 0::2], rest[..., 1::2] = np.floor(position), np.ceil(position)
        asked = np.flatnonzero(np.broadcast_to(size[..., None] > 0, shape))
        ask = spark.createDataFrame(pd.DataFrame({"at": asked, "wanted": wanted.reshape(-1)[asked], "rest": rest.reshape(-1)[asked]}), "at long, wanted long, rest long")
        hit = reached.join(F.broadcast(ask), "wanted").where("upto > rest AND upto - n <= rest").select("at", "digit", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")).toPandas()
        if step == 0:
            reached.unpersist()
        at = hit["at"].to_numpy(np.int64)
        found = found << np.uint64(_DIGIT)
        found.reshape(-1)[at] |= hit["digit"].to_numpy(np.int64).astype(np.uint64)
        rest.reshape(-1)[at] = hit["rest"].to_numpy(np.int64)
    value = preimage(found)
    low, high = value[..., 0::2], value[..., 1::2]
    with np.errstate(invalid="ignore"):
        between = (np.ceil(position) - position) * low + (position - np.floor(position)) * high
    out = np.where(low == high, low, between)
    rows = [(int(t), *[out[c, i].tolist() if size[c, i] else None for c in range(len(columns))]) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, ", ".join([schema, *[f"`{c.replace('`', '``')}` array<double>" for c in columns]]))
