"""SimHash near-duplicates over a grid of segment bit counts.

A fingerprint's bits are cut into segments of two; each segment's bit count (0, 1
or 2) is a coordinate. Fingerprints that differ in d bits lie at most d apart in
these coordinates under Manhattan distance, a lower bound. A range join over a
grid finds the points within d: the coordinates fall into ``groups``, at most d of
which can differ, so near points share a cell in a grid over all groups but d.
Pairs in a cell are filtered by the bound, then by the exact bits. Cells with many
points are not paired: there, points within two bits share a point that is at most
one bit from either, and each such meeting point links its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, quoted, stored
from tessera.llm.components import components

#: Cells with more points than this are linked through meeting points.
CROWDED = 64
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``size`` words; fewer words: of the whole sequence; none: nothing."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, 42)]
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :])]  # noqa: B905


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The lane's own 64 bits of each hash; lane 0 is the hash."""
    if not lane:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signatures(texts: list[str], size: int, lanes: int = 1) -> np.ndarray:
    """A row of ``lanes`` unsigned 64-bit words for each text: a bit is 1 if set in over half its hashes.

    Bits are counted eight at a time in the bytes of a word, over at most 255 hashes, and these counts added.
    """
    return set_signatures([np.array(shingle_hashes(t, size), dtype=np.uint64) for t in texts], lanes)


def set_signatures(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """``signatures`` of texts that are given as their hashes."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    out = np.zeros((len(sets), lanes), dtype=np.uint64)
    if not sizes.any():
        return out
    full = np.flatnonzero(sizes)
    parts = -(-sizes[full] // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(sizes)[full] - sizes[full], parts) + 255 * within
    h0 = np.concatenate(sets)
    for lane in range(lanes):
        h = _mixed(h0, lane)
        sums = np.stack([np.add.reduceat((h >> np.uint64(k)) & _LANES, starts) for k in range(8)], axis=1)
        counts = sums.view(np.uint8).reshape(len(starts), 8, 8).transpose(0, 2, 1).reshape(len(starts), 64)
        counts = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        bits = counts * 2 > sizes[full][:, None]
        out[full, lane] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _batches(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= chars):
            total += len(texts[upto])
            upto += 1
        yield slice(at, upto)
        at = upto


def fingerprint_words(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signature of each document's whole text as a signed word."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [signatures(texts[part], size).view(np.int64)[:, 0] for part in _batches(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(words) if words else [], pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_EVEN = 0x5555555555555555


def embedding(fp: Column) -> Column:
    """The 32 segment counts in thermometer code (0, 01, 11), so that Manhattan distance is a bit count."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(radius: int, groups: int) -> list[int]:
    """For each choice of ``groups - radius`` groups of segments, the bits of their coordinates."""
    cuts = [32 * g // groups for g in range(groups + 1)]
    group = [sum(3 << 2 * s for s in range(cuts[g], cuts[g + 1])) for g in range(groups)]
    return [_signed(sum(group[g] for g in chosen)) for chosen in combinations(range(groups), groups - radius)]


def groups_for(points: int, radius: int = 2) -> int:
    """How many groups of segments: a cell's key lengthens with the points, so that few meet in a cell by chance at every size.

    A segment's count has 1.5 bits of information, and ``groups - radius`` of the groups are the key.
    """
    groups = radius + 3
    while groups < 16 and 48 * (groups - radius) / groups < max(points, 1).bit_length() + 2:
        groups += 1
    return groups


def links(points: DataFrame, radius: int = 2, groups: int = 5, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fp`` within ``radius`` (1 or 2) bits.

    ``points`` has one row for each different ``fp``.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = grid_masks(radius, groups)
    cells = points.select(
        "fp",
        embedding(F.col("fp")).alias("t"),
        F.posexplode(F.transform(F.array(*map(F.lit, masks)), lambda m: embedding(F.col("fp")).bitwiseAND(m))).alias("grid", "cell"),
    )
    counts = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = stored(cells.join(counts, ["grid", "cell"]), "cells")
    few = busy.where(F.col("n") <= crowded)
    a = few.select("grid", "cell", F.col("fp").alias("a"), F.col("t").alias("ta"))
    b = few.select("grid", "cell", F.col("fp").alias("b"), F.col("t").alias("tb"))
    near = a.join(b, ["grid", "cell"]).where(
        (F.col("a") > F.col("b"))
        & (F.bit_count(F.col("ta").bitwiseXOR(F.col("tb"))) <= radius)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    ).select("a", "b")
    full = busy.where(F.col("n") > crowded).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    meet = full.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("x"))
    if radius == 1:  # two points at one bit: one of them is the meeting point of both
        least = meet.withColumn("b", F.min(F.when(F.col("fp") == F.col("x"), F.col("fp"))).over(Window.partitionBy("x")))
    else:  # a meeting point has at most 65 points
        least = meet.withColumn("b", F.min("fp").over(Window.partitionBy("x")))
    return near.unionAll(least.where("b is not null and fp <> b").select(F.col("fp").alias("a"), "b"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    Fingerprints of equal value or within ``radius`` bits are linked;
    component_id is the least id reachable. Null texts are empty; texts without
    words have fingerprint zero and are linked like others. Repeated rows and ids
    are ordinary; null ids never name a component (one of null ids only has a
    null one). An empty table gives no row; other columns are ignored.
    """
    fps = stored(fingerprint_words(docs, size, id_col, text_col), "fingerprints")
    firsts = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    found = components(links(firsts.select("fp"), radius, groups_for(firsts.count(), radius)))
    rooted = firsts.join(found, firsts["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- documents at a similarity of 0.8 or more ------------------------------------

_WIDE = 16
#: Signatures of pairs at the similarity or above differ in at most so many bits: six
#: deviations over the mean of the least alike such sets (four shingles of five, 3/16 of the bits).
FAR = 64 * _WIDE * 3 // 16 + 75
#: Bits of the tables that go to the tasks: 64 each for what they hold, within these bounds. Full tables cost time, not results.
TABLE_BITS = (1 << 12, 1 << 26)


def shingle_set(text: str, size: int) -> np.ndarray:
    """The text's different shingles as sorted hashes."""
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def _table(keys: DataFrame) -> np.ndarray:
    """A bit table with the places of the column ``key`` set; one row for each 64 bits reaches the driver."""
    bits = min(max(1 << (64 * max(keys.count(), 1) - 1).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((key & {bits - 1}L) & 63 AS INT))")).alias("x")).collect()
    out = np.zeros(bits // 64, dtype=np.uint64)
    for i, x in words:
        out[i] = np.uint64(x & (2**64 - 1))
    return out


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def common_shingles(docs: DataFrame, size: int, text_col: str, one_in: int = 16, often: int = 4) -> np.ndarray:
    """A table of the hashes of shingles that ``often`` texts of the sample hold (others of equal place count as common too)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0).select(text.alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), size).view(np.int64))], names=["key"])

    found = rows.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= often)
    return _table(stored(found.select("key"), "common-shingles"))


def prefix(x: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set of which one at least is shared by any set at the similarity.

    Sets of m and n shingles that share at least the similarity of their union share at least
    that part of m; so, in one order of all shingles, they meet in the first m - similarity * m + 1.
    The order puts common shingles last. It may be any: only the number of meetings depends on it.
    Each is given as a number whose order is that one (common or not, then the hash's upper 63 bits).
    """
    n = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1 if len(x) else 0
    return np.sort((x >> np.uint64(1)).view(np.int64) + np.where(_marked(common, x), 0, -(2**63)))[:n]


SHINGLED = "doc_id long, extra long, pid long, m int, w array<long>, prefix array<long>, text string"


def shingled(docs: DataFrame, size: int, similarity: float, common: np.ndarray, id_col: str, text_col: str, extra: Column) -> DataFrame:
    """Each row's set of shingles: its number, size, signature and prefix; and the text.

    Texts of one set have one number, a hash of the set; -1 is that of no shingle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), extra.cast("long").alias("extra"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column("text").to_pylist()
                for part in _batches(texts):
                    sets = [shingle_set(t, size) for t in texts[part]]
                    own = some.slice(part.start, part.stop - part.start)
                    columns = [
                        pa.array([xxhash.xxh64_intdigest(x.tobytes(), 7) >> 1 if len(x) else -1 for x in sets], pa.int64()),
                        pa.array([len(x) for x in sets], pa.int32()),
                        pa.array(list(set_signatures(sets, _WIDE).view(np.int64)), pa.list_(pa.int64())),
                        pa.array([prefix(x, held.value, similarity) for x in sets], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("extra"), *columns, own.column("text")], names=[c.split()[0] for c in SHINGLED.split(", ")])

    return rows.mapInArrow(run, SHINGLED)


def _chosen_cells(points: DataFrame) -> DataFrame:
    """(cell, lead): the first cell, in the order of shingles, of each different membership of two or more points, and its least point.

    So the first shingle that two sets share is in a chosen cell, or one of the same
    points is before it. Cells are pre-aggregated: one with a third of all points is one
    row a task. A membership is told by its least point and the hashes of all.
    """
    cells = points.select("pid", F.explode("prefix").alias("cell"))
    mark = F.xxhash64("pid")
    seen = cells.groupBy("cell").agg(F.min("pid").alias("lead"), F.bit_xor(mark).alias("mark"))
    several = seen.where(F.col("mark") != F.xxhash64("lead"))
    return stored(several.groupBy("lead", "mark").agg(F.min("cell").alias("cell")).select("cell", "lead"), "cells")


def _members(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cell, pid, m, at, w) of the chosen cells' points, with the shingle's place in the point's order; a table of bits keeps most other cells from being dealt out."""
    held = points.sparkSession.sparkContext.broadcast(_table(chosen.select(F.col("cell").alias("key"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("prefix").value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = batch.column("prefix").flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            i = np.flatnonzero(_marked(held.value, np.ascontiguousarray(flat, dtype=np.int64)))
            own = np.searchsorted(starts + sizes, i, side="right")
            pid, m, w = (batch.column(c).take(pa.array(own)) for c in ("pid", "m", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(flat[i]), pid, m, pa.array((i - starts[own]).astype(np.int32)), w], names=["cell", "pid", "m", "at", "w"])

    few = points.where("m > 0").select("pid", "m", "w", "prefix").mapInArrow(run, "cell long, pid long, m int, at int, w array<long>")
    return stored(few.join(chosen.select("cell"), "cell"), "members")


def _apart(a: str, b: str) -> Column:
    return sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(_WIDE))


def _verified(pairs: DataFrame, points: DataFrame, size: int, similarity: float) -> DataFrame:
    """(x, y) of the pairs (a, b, x, y) whose texts' sets share at least ``similarity`` of their union; ``b`` may be repeated often.

    Only the texts that the pairs name (and a few others) are dealt out.
    """
    pairs = stored(pairs, "pairs")
    ends = stored(pairs.select(F.col("a").alias("key")).distinct().unionAll(pairs.select("b").distinct()).distinct(), "ends")
    held = pairs.sparkSession.sparkContext.broadcast(_table(ends))

    @F.pandas_udf("boolean")
    def named(pid: pd.Series) -> pd.Series:
        return pd.Series(_marked(held.value, pid.to_numpy(np.int64)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, own = None, None
        for batch in batches:
            keep = []
            b = batch.column("b").to_pylist()
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, own = b[i], shingle_set(batch.column("tb")[i].as_py(), size)
                x = shingle_set(batch.column("ta")[i].as_py(), size)
                both = len(np.intersect1d(x, own, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(own) - both) - 1e-9)
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    texts = points.select("pid", "text").where(named("pid"))
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    out = stored(both.select("b", "x", "y", "ta", "tb").mapInArrow(run, "x long, y long").distinct(), "verified")
    dropped(pairs, ends)
    return out


def _pointed(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(pid, class) after the links (x, y) from classes to those of their leaders: each follows its least link, and that one's.

    Classes that are linked may stay apart; that costs comparisons, not results.
    """
    least = links.groupBy("x").agg(F.min("y").alias("y"))
    down = least.toDF("y", "z")
    least = stored(least.join(down, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "pointers")
    fresh = least.select(F.col("x").alias("pid"), F.col("y").alias("class"))
    if classes is None:
        return fresh
    moved = classes.join(least, classes["class"] == least["x"], "left").select("pid", F.coalesce("y", "class").alias("class"))
    return stored(moved.unionAll(fresh), "classes")


def grid_pairs(points: DataFrame, similarity: float, radius: int = 2) -> DataFrame:
    """(a, b, x, y): SimHash pairs of points, one at most for each point and each fingerprint, by the range join over the grid.

    A point's fingerprint is the first word of its signature. Points of equal fingerprints pair with the least of
    them, and each fingerprint with the least that ``links`` gives it. Sizes drop pairs that cannot be alike.
    """
    own = points.where("m > 0").select("pid", "m", F.col("w")[0].alias("fp"))
    firsts = stored(own.groupBy("fp").agg(F.min(F.struct("pid", "m")).alias("first")).select("fp", "first.*"), "fingerprints")
    near = links(firsts.select("fp"), radius, groups_for(firsts.count(), radius)).groupBy("a").agg(F.min("b").alias("b"))
    first = firsts.select("fp", F.col("pid").alias("b"), F.col("m").alias("mb"))
    equal = own.join(first, "fp").where("pid <> b").select(F.col("pid").alias("a"), "m", "b", "mb")
    other = near.join(firsts.select(F.col("fp").alias("a"), F.col("pid").alias("pa"), "m"), "a").join(first.withColumnRenamed("b", "pb"), F.col("b") == F.col("fp"))
    pairs = equal.unionAll(other.select(F.col("pa").alias("a"), "m", F.col("pb").alias("b"), "mb")).where(F.least("m", "mb") >= similarity * F.greatest("m", "mb") - 1e-9)
    return pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))


def similar_points(points: DataFrame, size: int = 5, similarity: float = 0.8, rounds: int = 1) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of sets at the similarity or above.

    ``points`` (pid, m, w, prefix, text) has one row for each set. SimHash comes first: pairs of
    near fingerprints from the grid, verified by their sets, make the first classes. A fingerprint cannot
    keep every link at the similarity, so an exact search follows. Sets that are alike share
    a cell (``prefix``), and cells of equal membership are one. Places, sizes and signatures
    only drop pairs that cannot be alike, and the sets decide: at the first shingle that two
    sets share, no more than it and what follows can be shared; ``FAR`` bounds signatures. Each point is held
    against two leaders of its cells, the closest and the greatest, in ``rounds`` passes, and what that links
    is one class (a cell's leader is its point that meets most others: near copies are mostly
    alike to what they were copied from, not to each other); then all pairs of different classes in a cell are compared, so that a large
    group of near copies is not paired with itself and no link between classes is lost.
    """
    chosen = _chosen_cells(points)
    plain = _members(points, chosen)
    sizes = plain.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    meets = plain.select("cell", "pid").join(sizes, "cell").groupBy("pid").agg(F.sum("n").alias("meets"))
    members = stored(plain.join(meets, "pid"), "members")
    dropped(plain)
    found = [_verified(grid_pairs(points, similarity), points, size, similarity)]
    classes, spent = _pointed(None, found[0]), [chosen, members]

    def may(m: str, at: str, mb: str, at_b: str, w: str, wb: str) -> Column:
        sized = F.least(m, mb) >= similarity * F.greatest(m, mb) - 1e-9
        left = F.least(F.col(m) - F.col(at), F.col(mb) - F.col(at_b))
        return sized & (left >= (F.col(m) + F.col(mb)) * (similarity / (1 + similarity)) - 1e-9) & (_apart(w, wb) <= FAR)

    def classed() -> tuple[DataFrame, DataFrame]:
        """The members with their classes, and the least class and the leader of each cell that has several."""
        known = stored(members.join(classes, "pid", "left").withColumn("class", F.coalesce("class", "pid")), "classed")
        spent.append(known)
        least = known.groupBy("cell").agg(F.min("class").alias("of"), F.max("class").alias("last"), F.max_by("pid", F.struct("meets", "pid")).alias("lead"))
        spent.append(stored(least.where("of < last").select("cell", "of", "lead"), "mixed-cells"))
        return known, spent[-1]

    for _ in range(rounds):
        known, mixed = classed()
        leads = stored(mixed.join(known.select("cell", F.col("pid").alias("lead"), F.col("class").alias("y"), F.col("meets").alias("most"), F.col("m").alias("mb"), F.col("at").alias("at_b"), F.col("w").alias("wb")), ["cell", "lead"]), "leads")
        met = known.join(leads, "cell").where((F.col("class") != F.col("y")) & may("m", "at", "mb", "at_b", "w", "wb")).select(F.col("pid").alias("a"), F.col("class").alias("x"), _apart("w", "wb").alias("d"), "most", F.col("lead").alias("b"), "y")
        spent.append(leads)
        best = [F.min(F.struct("d", "b", "y")).alias("near"), F.max(F.struct("most", "b", "y")).alias("main")]
        ends = F.array_distinct(F.array(*[F.struct(F.col(f"{e}.b").alias("b"), F.col(f"{e}.y").alias("y")) for e in ("near", "main")]))
        star = met.groupBy("a", "x").agg(*best).select("a", "x", F.explode(ends).alias("end")).select("a", "end.b", "x", "end.y")
        found.append(_verified(star, points, size, similarity))
        classes = _pointed(classes, found[-1])
    known, mixed = classed()
    rest = known.join(mixed.select("cell", "of"), "cell")
    a = rest.where("class > of").select("cell", F.col("pid").alias("a"), "m", "at", "w", F.col("class").alias("x"))
    b = rest.select(F.col("cell").alias("cell_b"), F.col("pid").alias("b"), F.col("m").alias("mb"), F.col("at").alias("at_b"), F.col("w").alias("wb"), F.col("class").alias("y"), "of")
    once = (F.col("y") == F.col("of")) | ((F.col("x") != F.col("y")) & (F.col("a") > F.col("b")))
    near = a.join(b, (F.col("cell") == F.col("cell_b")) & once & may("m", "at", "mb", "at_b", "w", "wb"))
    found.append(_verified(near.select("a", "b", "x", "y").distinct(), points, size, similarity))
    dropped(*spent)
    edges = classes.toDF("a", "b")
    for more in found:
        edges = edges.unionAll(more.toDF("a", "b"))
    return edges


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least id (null ids last).

    Null texts are empty; texts without words form one group. Repeated rows are
    copies. All columns stay, whatever their names.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())
    sets = shingled(docs, size, similarity, common_shingles(docs, size, text_col), id_col, text_col, text_hash)
    points = stored(
        sets.groupBy("pid").agg(
            *[F.first(c).alias(c) for c in ("m", "w", "prefix", "text")],
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("extra").alias("h"))).alias("key"),
        ),
        "points",
    )
    found = components(similar_points(points, size, similarity, **how))
    rooted = points.select("pid", "key").join(found.toDF("pid", "root"), "pid", "left")
    kept = rooted.groupBy(F.coalesce("root", "pid").alias("root")).agg(F.min("key").alias("key"))
    # the texts are dealt once by this key, for the join and for the repeated rows
    kept = stored(kept.select(F.xxhash64("key.doc_id", "key.h").alias("k"), F.col("key.doc_id").alias("kept_id"), F.col("key.h").alias("kept_h")), "kept")
    dropped(points)
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), text_hash.alias("h")).withColumn("k", F.xxhash64("id", "h"))
    chosen = rows.join(kept, (rows["k"] == kept["k"]) & F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi")
    return chosen.dropDuplicates(["k", "id", "h"]).select("row.*")
