"""Correlations of all pairs over a moving window.

Periods are cut into runs. For a run, a task holds one block of sources and meets
the blocks of targets one after the other; of each source it keeps the k best
alone, or hands all pairs at the threshold on as they are found. Blocks meet in
tiles. Windows of up to ``WHOLE`` periods are products of unit vectors. Longer
ones are updated from period to period: going one period on adds the newest
returns' products and takes away the oldest ones', whatever the window's length.
Each run starts from whole sums, and returns are first centred on their mean in
the run, so rounding does not add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import stored
from tessera.operators.blocks import Measure

#: Periods in a run, entities in a block (a task holds two) and in a tile: a task scores TILE x TILE pairs of a period at once.
RUN, BLOCK, TILE = 32, 2048, 512
#: The longest window that is multiplied as a whole.
WHOLE = 400
SMALL = 1e-12
#: More than single precision can be off in a correlation of up to ``WHOLE`` periods.
ROUGH = 1e-4


def window_parts(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's mean and root sum of centred squares (periods x entities); NaN is missing, windows without values give 0."""
    views = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)
    held = ~np.isnan(views)
    count = held.sum(axis=-1)
    mean = np.where(held, views, 0.0).sum(axis=-1) / np.maximum(count, 1)
    centred = np.where(held, views - mean[..., None], 0.0)
    varies = np.where(held, views, -np.inf).max(axis=-1) > np.where(held, views, np.inf).min(axis=-1)
    return mean, np.where(varies, np.sqrt((centred * centred).sum(axis=-1)), 0.0)


def correlations(x: np.ndarray, y: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """For each window, the correlations of all columns of x with all of y; the first window - 1 rows come before the first window ends.

    A return's deviation is from the mean of its entity's own values in the
    window; pairs of which one is missing count 0. Windows of one value, or
    without variation, correlate with nothing.
    """
    both = [(v - np.nan_to_num((np.nansum(v, axis=0) / np.maximum((~np.isnan(v)).sum(axis=0), 1)))) for v in (x, y)]
    (mx, nx), (my, ny) = (window_parts(v, window) for v in both)
    held = [(~np.isnan(v)).astype(float) for v in both]
    a, b = (np.nan_to_num(v) for v in both)
    pairs = [(a, b)]
    if not (held[0].all() and held[1].all()):
        pairs += [(a, held[1]), (held[0], b), (held[0], held[1])]
    sums = [u[: window - 1].T @ v[: window - 1] for u, v in pairs]
    for p in range(len(mx)):
        for total, (u, v) in zip(sums, pairs, strict=True):
            rows = [p + window - 1] if p == 0 else [p + window - 1, p - 1]
            signs = np.array([1.0, -1.0][: len(rows)])
            total += (u[rows] * signs[:, None]).T @ v[rows]
        m, n = mx[p][:, None], my[p][None, :]
        if len(sums) == 1:
            dots = sums[0] - window * m * n
        else:
            dots = sums[0] - n * sums[1] - m * sums[2] + m * n * sums[3]
        flat = (nx[p] < SMALL)[:, None] | (ny[p] < SMALL)[None, :]
        yield np.where(flat, 0.0, dots / np.where(flat, 1.0, nx[p][:, None] * ny[p][None, :]))


def _units(x: np.ndarray, p: int, window: int, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The p-th window's deviations, of length 1 (entities x window); missing values and windows without variation are 0."""
    mean, norm = parts[0][p], parts[1][p]
    flat = norm < SMALL
    v = (x[p : p + window] - mean) / np.where(flat, 1.0, norm)
    v[np.isnan(v)] = 0.0
    v[:, flat] = 0.0
    return v.T


class _Best:
    """The k best positive scores of each source in one period, the least target first among equals."""

    def __init__(self, sources: int, k: int):
        self.k, self.score, self.to = k, np.zeros((sources, k)), np.full((sources, k), np.iinfo(np.int64).max)

    def limit(self, start: int, end: int) -> np.ndarray:
        return self.score[start:end, -1:]

    def add(self, i: np.ndarray, to: np.ndarray, score: np.ndarray) -> None:
        better = (score > self.score[i, -1]) | ((score == self.score[i, -1]) & (score > 0) & (to < self.to[i, -1]))
        i, to, score = i[better], to[better], score[better]
        rows = np.unique(i)
        if not len(rows):
            return
        i, to, score = np.r_[np.repeat(rows, self.k), i], np.r_[self.to[rows].ravel(), to], np.r_[self.score[rows].ravel(), score]
        order = np.lexsort((to, -score, i))
        i, to, score = i[order], to[order], score[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        self.to[rows], self.score[rows] = to[kept].reshape(-1, self.k), score[kept].reshape(-1, self.k)


def correlated(returns: DataFrame, lookback: int, measure: Measure, largest: int, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """(t, src, dst, score): the k best, or all at the threshold, of each source and period; scores above 0 alone, as no other is an edge.

    An entity takes part in the periods in which it has a row; a missing return
    has no value. ``largest`` is the size of the largest period.
    """
    blocks = max(1, -(-largest // block))
    rows = returns.select("t", "id", F.nanvl(F.col("y").cast("double"), F.lit(None)).alias("y"))
    runs = F.sequence(F.expr(f"t div {run}"), F.expr(f"(t + {lookback - 1}) div {run}"))
    dealt = rows.select("t", "id", "y", F.explode(runs).alias("run"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    length, k = run + lookback - 1, measure.k
    # rounding may lift a score by half a digit
    slack = 0.0 if measure.digits is None else 10.0**-measure.digits

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's returns in a run and the window before it, as one row; none where only the next run begins with them."""
        first = int(pdf["run"].iloc[0]) * run - (lookback - 1)
        ids, column = np.unique(pdf["id"].to_numpy(np.int64), return_inverse=True)
        x, there = np.full((length, len(ids)), np.nan), np.zeros((length, len(ids)), bool)
        at = pdf["t"].to_numpy() - first
        x[at, column], there[at, column] = pdf["y"].to_numpy(float, na_value=np.nan), True
        there = there[lookback - 1 :]
        some = there.any(axis=0)
        ids, x, there = ids[some], x[:, some], there[:, some]
        row = pd.DataFrame({"run": [int(pdf["run"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "ids": [ids.tobytes()], "x": [x.tobytes()], "there": [there.tobytes()]})
        return row if some.any() else row.iloc[:0]

    packed = stored(dealt.groupBy("run", "block").applyInPandas(pack, "run long, block int, ids binary, x binary, there binary"), "runs")
    # a block meets itself first, then the others; at a threshold each two blocks meet once
    ahead = F.pmod(F.col("block") - F.col("home"), F.lit(blocks))
    homes = packed.select("run", F.col("block").alias("home"))
    meeting = packed.join(F.broadcast(homes), "run").withColumn("ahead", ahead)
    if k is None:
        meeting = meeting.where((F.col("ahead") * 2 < blocks) | ((F.col("ahead") * 2 == blocks) & (F.col("home") < F.col("block"))))
    parts = max(int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    met = meeting.repartitionById(parts, F.pmod(F.col("run") * blocks + F.col("home"), F.lit(parts)).cast("int")).sortWithinPartitions("run", "home", "ahead").select("run", "home", "ahead", "ids", "x", "there")

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held[:] = np.empty((TILE, TILE), np.float32), np.empty((TILE, TILE), bool)
        names = ["t", "src", "dst", "score"]
        own, best = None, {}

        def kept() -> Iterator:
            """What the held block's sources have found."""
            for p, b in best.items():
                i, j = np.nonzero(b.score > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), own[0] * run + p, np.int32)), pa.array(own[1][i]), pa.array(b.to[i, j]), pa.array(b.score[i, j])], names=names)

        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                x, there = np.frombuffer(row["x"]).reshape(length, -1), np.frombuffer(row["there"], bool).reshape(run, -1)
                to = row["run"], ids, x, there, window_parts(x, lookback)
                if row["ahead"] == 0:
                    yield from kept()
                    own, best = to, {int(p): _Best(len(ids), k) for p in np.flatnonzero(there.any(axis=1))} if k is not None else {}
                found: dict[int, list] = {}
                for a in range(0, len(own[1]), TILE):
                    for p, i, j, s in _near(own, to, a, best, row["ahead"] == 0):
                        if k is not None:
                            best[p].add(i, ids[j], s)
                        else:
                            found.setdefault(p, []).append((own[1][i], ids[j], s))
                for p, lists in found.items():
                    src, dst, s = (np.concatenate(v) for v in zip(*lists, strict=True))
                    t = pa.array(np.full(len(s), row["run"] * run + p, np.int32))
                    for u, v in ((src, dst), (dst, src))[: 1 if row["ahead"] == 0 else 2]:
                        yield pa.RecordBatch.from_arrays([t, pa.array(u), pa.array(v), pa.array(s)], names=names)
        yield from kept()

    def _near(own: tuple, to: tuple, a: int, best: dict, same: bool) -> Iterator:
        """(period, source places, target places, scores) of the pairs that may count, for the TILE sources from ``a`` on."""
        mine = slice(a, min(a + TILE, len(own[1])))
        here, parts = own[3][:, mine], [v[:, mine] for v in own[4]]
        periods = np.flatnonzero(here.any(axis=1) & to[3].any(axis=1))
        if lookback > WHOLE:
            tables = ((p, found) for p, found in enumerate(correlations(own[2][:, mine], to[2], lookback)) if p in periods)
        else:
            tables = ((p, None) for p in periods)
        for p, table in tables:
            u, v = _units(own[2][:, mine], p, lookback, parts), _units(to[2], p, lookback, to[4])
            short, short_to = u.astype(np.float32), v.astype(np.float32)
            limit = np.full((len(u), 1), measure.threshold) if k is None else best[p].limit(mine.start, mine.stop)
            lists = []
            for b in range(0, len(v), TILE):
                theirs = slice(b, min(b + TILE, len(v)))
                # half as long numbers tell which pairs may count; these alone are computed in full
                found = np.matmul(short, short_to[theirs].T, out=held[0][: len(u), : theirs.stop - b]) if table is None else table[:, theirs]
                if measure.absolute:
                    np.abs(found, out=found)
                off = [~here[p], ~to[3][p, theirs]]
                found[off[0]], found[:, off[1]] = -1.0, -1.0
                if same and a == b:
                    np.fill_diagonal(found, -1.0)
                if k is not None and found.shape[1] > k and not limit.all():
                    limit = np.maximum(limit, np.partition(found, -k, axis=1)[:, -k:][:, :1] - ROUGH)
                at = np.flatnonzero(np.greater_equal(found, (np.maximum(limit, 0.0) - slack - ROUGH).astype(found.dtype), out=held[1][: len(u), : theirs.stop - b]))
                i, j = at // found.shape[1], at % found.shape[1]
                if table is not None:
                    s = found[i, j]
                elif len(at) * 16 > found.size:
                    s = (u @ v[theirs].T)[i, j]
                else:
                    s = np.einsum("ij,ij->i", u[i], v[theirs][j])
                if measure.absolute:
                    s = np.abs(s)
                if measure.digits is not None:
                    s = np.round(s, measure.digits)
                right = (s > 0) & (s >= measure.threshold if k is None else True) & ~(off[0][i] | off[1][j])
                if same and a == b:
                    right &= i != j
                lists.append((i[right] + a, j[right] + b, s[right]))
            yield int(p), *(np.concatenate(x) for x in zip(*lists, strict=True))

    held = []

    return met.mapInArrow(score, "t int, src long, dst long, score double")
