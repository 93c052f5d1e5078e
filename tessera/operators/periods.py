"""Graph steps of a whole period in one task, where no period is larger than a task may hold.

Symmetrising, loops, normalising and all hops of a period need its directed edges
and its nodes once. Done one by one on edge tables, each of them moves every edge
(both directions, and for a hop all its columns) again. Larger periods take that way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.guards import TINY

#: Directed edges and nodes of a period that a task holds at most.
EDGES, NODES = 4_000_000, 500_000


def fit(panel: DataFrame, edges: DataFrame) -> bool:
    """Whether a task may hold any period (two numbers on the driver); reads both tables, so they should be stored."""
    most = [df.groupBy("t").count().agg(F.max("count")).first()[0] or 0 for df in (panel, edges)]
    return most[0] <= NODES and most[1] <= EDGES


def _or_one(d: np.ndarray) -> np.ndarray:
    return np.where(d < TINY, 1.0, d)


def finished(n: int, loops: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, symmetric: bool = True, self_loop: bool = False, row_norm: bool = True, gcn_norm: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``graph.finished`` for one period of n nodes by place, of which the first ``loops`` get a loop; an edge may come in several parts."""
    if symmetric:
        src, dst, w = np.r_[src, dst], np.r_[dst, src], np.r_[w, w] / 2
    if self_loop:
        own = np.arange(loops)
        src, dst, w = np.r_[src, own], np.r_[dst, own], np.r_[w, np.ones(loops)]
    if gcn_norm or row_norm:
        d = _or_one(np.bincount(src, w, n))
        w = w / (np.sqrt(d[src] * d[dst]) if gcn_norm else d[src])
    return src, dst, w


def hops(panel: DataFrame, edges: DataFrame, columns: list[str], count: int, names: Callable[[str, int], str], kept: list[str], grid: list[int] | None = None, **last) -> DataFrame:
    """(t, id, kept..., names...): the neighbours' weighted sums of ``columns`` after 1 to ``count`` hops over the finished edges.

    ``last`` are the switches of ``graph.finished``, the edges come without them. With ``grid``, edges up to each
    of these ranks are a graph of their own, and a column ``g`` has its place. A missing value counts as 0.
    """
    made = [names(c, h) for h in range(1, count + 1) for c in columns]
    x = [f"_x{i}" for i in range(len(columns))]
    nodes = panel.select("t", "id", *kept, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, x, strict=True)])
    ranks = ["rank"] if grid else []
    links = edges.select("t", "src", "dst", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"), *ranks)

    def run(own: pd.DataFrame, linked: pd.DataFrame) -> pd.DataFrame:
        # ends that are no node have no values
        places = pd.Index(own["id"]).append(pd.Index(pd.unique(np.r_[linked["src"], linked["dst"]])).difference(pd.Index(own["id"]))) if len(linked) else pd.Index(own["id"])
        n, here = len(places), len(own)
        src, dst, w = places.get_indexer(linked["src"]), places.get_indexer(linked["dst"]), linked["w"].to_numpy(float)
        start = np.zeros((len(columns), n))
        start[:, :here] = own[x].to_numpy(float).T
        out = []
        for g, most in enumerate(grid or [None]):
            of = slice(None) if most is None else linked["rank"].to_numpy() <= most
            i, j, v = finished(n, here, src[of], dst[of], w[of], **last)
            current, found = start, []
            for _ in range(count):
                current = np.stack([np.bincount(i, v * c[j], n) for c in current])
                current[:, here:] = 0.0
                found += list(current[:, :here])
            table = own[["t", "id", *kept]].assign(**({"g": np.int32(g)} if grid else {}))
            out.append(pd.concat([table, pd.DataFrame(dict(zip(made, found, strict=True)), index=table.index)], axis=1))
        return pd.concat(out) if out else out

    types = {f.name: f.dataType.simpleString() for f in panel.schema.fields}
    kinds = [*((c, types[c]) for c in ("t", "id", *kept)), *([("g", "int")] if grid else []), *((m, "double") for m in made)]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds)
    return nodes.groupBy("t").cogroup(links.groupBy("t")).applyInPandas(run, schema)
