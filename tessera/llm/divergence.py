"""How the sources of a language differ in their words: pairs of sources, and the terms that mark each.

A term's share of a group (a source of a language) is smoothed and scaled to
whole numbers, ``p = 1 + floor(10**9 * (count + 2) / (N + 2 V))``; two shares
differ by ``floor((p - q)**2 / (p + q))``. All of it is exact in 64 bits.

The terms that mark a group are found by a dominance skyband. For shares
``p > q`` of group and language the value grows with the group's count and
falls with the language's. So a term is outranked by every term that has no
fewer occurrences in the group, no more in the language, and comes earlier in
UTF-8 order; one that ``k`` others dominate this way is not among the first
``k``. Each partition keeps, for each group, the terms that fewer than ``k``
others of the partition dominate; bands are merged over parts of the terms'
hashes and then over the group, and what is left is ranked by exact values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, tasks

SCALE = 10**9
#: A-Z in lower case; what belongs to no term is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Distinct terms of a group that a task holds before it hands their counts on.
HELD = 400_000
#: Candidates that a task holds before it keeps only their skyband.
CANDIDATES = 20_000


def terms(text: bytes) -> list[bytes]:
    """The runs of letters and characters beyond ASCII of a UTF-8 text, A-Z lower-cased."""
    return text.translate(TABLE).split()


def shares(count: np.ndarray, total: np.ndarray | int, kept: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 kept)): long division by thousands, exact while the divisor is below 9 * 10**15."""
    divisor = np.asarray(total, np.int64) + 2 * np.asarray(kept, np.int64)
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, divisor)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digit
    return 1 + whole


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def skyband(group: np.ndarray, lang: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """The places of the terms that fewer than ``k`` others dominate.

    In the order (group count falling, language count, name) a term comes after
    all that dominate it. Of equal counts only the first k names can stay. If k
    terms dominate one, k of the band do (the first k of its dominators are
    themselves dominated by fewer), so each is held against the band so far.
    """
    name_rank = np.empty(len(names), np.int64)
    name_rank[np.argsort(names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((name_rank, lang, -group))
    g, c = group[order], lang[order]
    fresh = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    order = order[place < k]
    c, n = lang[order], name_rank[order]
    band_c, band_n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    kept, size = [], 0
    for i, (own_c, own_n) in enumerate(zip(c.tolist(), n.tolist(), strict=True)):
        if size < k or np.count_nonzero((band_c[:size] <= own_c) & (band_n[:size] < own_n)) < k:
            band_c[size], band_n[size] = own_c, own_n
            size += 1
            kept.append(i)
    return order[kept]


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; term null: the group's documents."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        rows_of: Counter = Counter()

        def handed(key: tuple[str, str]) -> Iterator:
            n, d = found.pop(key)
            names = list(n)
            for lo in range(0, len(names), 50_000):
                own = names[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(own)), pa.array([key[1]] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[x] for x in own], pa.int64()), pa.array([d[x] for x in own], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for key in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                rows_of[key] += 1
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = terms(text)
                n, d = found.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                d.update(set(words))
            while sum(len(n) for n, _ in found.values()) > HELD:
                yield from handed(max(found, key=lambda x: len(found[x][0])))
        for key in list(found):
            yield from handed(key)
        if rows_of:
            langs, sources = zip(*rows_of, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(sources), pa.nulls(len(langs), pa.string()), pa.array([0] * len(langs), pa.int64()), pa.array(list(rows_of.values()), pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def banded(candidates: DataFrame, k: int) -> DataFrame:
    """Each partition's skyband of (lang, source, term, cg, cl), group by group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], list[pd.DataFrame]] = {}
        sizes: Counter = Counter()

        def band(key: tuple[str, str]) -> pd.DataFrame:
            own = pd.concat(held[key], ignore_index=True)
            names = np.array([x.encode() for x in own["term"]], dtype=object)
            return own.iloc[skyband(own["cg"].to_numpy(), own["cl"].to_numpy(), names, k)]

        for batch in batches:
            for key, own in batch.groupby(["lang", "source"], sort=False):
                held.setdefault(key, []).append(own)
                sizes[key] += len(own)
                if sizes[key] > CANDIDATES:
                    held[key] = [band(key)]
                    sizes[key] = 0
        for key in held:
            yield band(key)

    return candidates.mapInPandas(run, "lang string, source string, term string, cg long, cl long")


def audit(
    docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the other sources of the language with the summed difference
    of all kept terms. Part ``term``: the group's first ``top`` terms that it
    uses more than its language does. A language keeps the terms of at least
    ``least_docs`` of its documents. Null texts, languages and sources are
    empty strings; a group without terms has rows of part ``pair`` all the same,
    with value 0 where its language keeps no term. Equal values go by UTF-8.
    Repeated rows are documents of their own; an empty table gives no row; other
    columns are ignored.

    The result has a row for each pair of a language's sources. What grows less
    than that is held whole: the table of groups (broadcast), one term's counts
    in the sources, and a task's sums over the pairs.
    """
    spark = docs.sparkSession
    counted = term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = stored(counted, "divergence-counts")
    kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("cl"), F.collect_list(F.struct("source", F.col("n").alias("cg"))).alias("groups"))
    kept = stored(kept.where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")

    sizes = kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", "g.source").agg(F.sum("g.cg").alias("total"))
    groups = counted.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("cl").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    groups = groups.join(F.broadcast(langs), "lang", "left").select("lang", "source", "total", F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = stored(groups, "divergence-groups")

    table: dict[str, tuple[list[str], np.ndarray, int]] = {}
    for lang, own in groups.toPandas().sort_values(["lang", "source"]).groupby("lang"):
        table[lang] = (own["source"].tolist(), own["total"].to_numpy(np.int64), int(own["kept"].iloc[0]))
    shared = spark.sparkContext.broadcast(table)

    def pair_sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = {lang: {s: i for i, s in enumerate(own[0])} for lang, own in shared.value.items()}
        sums = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            lists = batch.column("groups")
            owner = np.repeat(np.arange(len(langs)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            source, counts = np.array(flat.field("source").to_pylist(), dtype=object), flat.field("cg").to_numpy()
            for lang in dict.fromkeys(langs):
                names, totals, size = shared.value[lang]
                own = np.flatnonzero(langs == lang)
                entries = np.flatnonzero(langs[owner] == lang)
                column = np.array([place[lang][s] for s in source[entries]], np.int64)
                total = sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
                step = max(1, 4_000_000 // len(names))
                for lo in range(0, len(own), step):
                    part = own[lo : lo + step]
                    dense = np.zeros((len(names), len(part)), np.int64)
                    inside = (owner[entries] >= part[0]) & (owner[entries] <= part[-1])
                    dense[column[inside], np.searchsorted(part, owner[entries][inside])] = counts[entries[inside]]
                    p = shares(dense, totals[:, None], size)
                    for i in range(len(names) - 1):
                        total[i, i + 1 :] += differences(p[i], p[i + 1 :]).sum(axis=1)
        for lang, total in sums.items():
            names = shared.value[lang][0]
            for i, name in enumerate(names):
                row = total[i] + total[:, i]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(names), "source": [name] * len(names), "item": names, "value": row.tolist()})

    added = kept.select("lang", "groups").mapInArrow(pair_sums, "lang string, source string, item string, value long")
    added = added.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(F.broadcast(others), "lang").where("source <> item").join(added, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    candidates = kept.select("lang", "term", "cl", F.explode("groups").alias("g")).select("lang", "g.source", "term", "g.cg", "cl")
    band = banded(candidates, top)
    for key in ([F.pmod(F.xxhash64("term"), F.lit(16))], []):  # merged in two steps, so no task meets all bands of a group
        band = banded(band.repartition(tasks(spark), "lang", "source", *key), top)

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, q = shares(b["cg"], b["total"], b["kept"]), shares(b["cl"], b["lang_total"], b["kept"])
            yield b.assign(value=np.where(p > q, differences(p, q), -1))[["lang", "source", "term", "value"]]

    exact = band.join(F.broadcast(groups), ["lang", "source"]).mapInPandas(valued, "lang string, source string, term string, value long")
    marks = exact.where("value >= 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.unionAll(marks).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle_sql() -> str:
    """The same by plain counting."""
    return """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
lt AS (SELECT lang, term, count(*) AS cl FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(cl)::HUGEINT AS n FROM lt GROUP BY ALL),
gt AS (SELECT lang, source, term, count(*)::HUGEINT AS cg FROM w SEMI JOIN lt USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(cg), 0)::HUGEINT AS n FROM g LEFT JOIN gt ON g.lang = gt.lang AND g.source = gt.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, lt.term, coalesce(cg, 0) AS cg,
    1 + (1000000000::HUGEINT * (coalesce(cg, 0) + 2)) // (gn.n + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (cl + 2)) // (v.n + 2 * v.v) AS q
    FROM gn JOIN lt ON gn.lang = lt.lang JOIN v ON v.lang = gn.lang
    LEFT JOIN gt ON gt.lang = gn.lang AND gt.source = gn.source AND gt.term = lt.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE cg > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10"""
