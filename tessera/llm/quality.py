"""Quality rules learned as a decision list from labelled document statistics.

Sequential covering: each rule is a conjunction of thresholds, grown condition by
condition on one part of the labelled rows and pruned on the other; rows it covers
are set aside, and the next rule is learned on the rest. The list becomes one
ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import quoted

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the rules may test, from the counts.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def statistics(text: str) -> tuple[int, ...]:
    """The counts of one text, and how many of its lines hold a word."""
    words = text.encode().split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.encode().split(b"\n") if line.split()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        runs = list(zip(words, words[1:], words[2:]))  # noqa: B905
        if len(set(runs)) < len(runs):
            seen: dict[tuple, int] = {}
            for r in runs:
                seen[r] = seen.get(r, 0) + 1
            upto = 0
            for i, r in enumerate(runs):
                if seen[r] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, dup, repeat, len(lines)


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of every whole text (null: empty)."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names = [s.split()[0] for s in STATS.split(", ")]
    schema = StructType([*fields, *(StructField(n, LongType()) for n in names)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            stats = [statistics(t) for t in batch.column("_text").to_pylist()]
            cols = list(zip(*stats, strict=True)) or [[]] * len(names)
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in cols)], names=[f.name for f in fields] + names)

    return rows.mapInArrow(run, schema)


@dataclass
class Rule:
    """Rejects where all conditions (feature, '<=' or '>', threshold) hold."""

    conditions: list[tuple[str, str, float]]
    precision: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), dtype=bool)
        for f, op, t in self.conditions:
            hit &= x[f] <= t if op == "<=" else x[f] > t
        return hit

    def column(self) -> Column:
        hit = F.lit(True)
        for f, op, t in self.conditions:
            c = F.expr(FEATURES[f]).cast("double")
            hit = hit & (c <= t if op == "<=" else c > t)
        return hit


def _gain(pos: np.ndarray, hit: np.ndarray, new: np.ndarray) -> float:
    """FOIL's information gain of narrowing ``hit`` to ``new``."""
    p0, n0, p1, n1 = (pos & hit).sum(), (~pos & hit).sum(), (pos & new).sum(), (~pos & new).sum()
    return p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0))) if p1 else 0.0


def _cuts(v: np.ndarray) -> np.ndarray:
    """Thresholds halfway between neighbouring values, at most about fifty."""
    values = np.unique(v)
    at = np.unique(np.searchsorted(values, np.quantile(v, np.linspace(0, 1, 51))))
    at = at[at < len(values) - 1]
    return (values[at] + values[at + 1]) / 2


def _precision(rule: Rule, x: dict, pos: np.ndarray) -> float:
    hit = rule.covers(x)
    return (pos[hit].sum() + 1) / (hit.sum() + 2)


def learn(stats: pd.DataFrame, rejected: np.ndarray, seed: int = 11, precision: float = 0.9, least: int = 5, most: int = 12) -> list[Rule]:
    """The list of rules; each must reach ``precision`` (Laplace) on rows it was not grown on."""
    order = np.random.default_rng(seed).permutation(len(stats))
    x = {f: stats[f].to_numpy(dtype=float)[order] for f in FEATURES}
    pos = rejected.astype(bool)[order]
    grow = np.arange(len(pos)) % 3 != 0
    left, rules = np.ones(len(pos), dtype=bool), []
    while len(rules) < most and (pos & left).sum() >= least:
        g, p = np.flatnonzero(left & grow), np.flatnonzero(left & ~grow)
        gx, px = {f: v[g] for f, v in x.items()}, {f: v[p] for f, v in x.items()}
        conditions, hit = [], np.ones(len(g), dtype=bool)
        while (~pos[g] & hit).any() and len(conditions) < 4:
            best = (0.0, None, None)
            for f, v in gx.items():
                for t in _cuts(v[hit]):
                    for op in ("<=", ">"):
                        new = hit & (v <= t if op == "<=" else v > t)
                        if (gain := _gain(pos[g], hit, new)) > best[0]:
                            best = (gain, (f, op, float(t)), new)
            if best[1] is None:
                break
            conditions.append(best[1])
            hit = best[2]
        rule = Rule(conditions, 0.0)
        while len(rule.conditions) > 1:
            shorter = Rule(rule.conditions[:-1], 0.0)
            if _precision(shorter, px, pos[p]) < _precision(rule, px, pos[p]):
                break
            rule = shorter
        rule.precision = float(_precision(rule, px, pos[p]))
        covered = rule.covers(x)
        if not rule.conditions or rule.precision < precision or (covered & left & pos).sum() < least:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **how) -> list[Rule]:
    """Learns from the documents of at most ``sample`` labels, the least by hash of the id.

    Null labels are left out; an id labelled twice counts once, as the lower label,
    and one that several documents have, by one of them.
    """
    known = labels.where("quality is not null").groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # so the broadcast is bounded
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")).join(F.broadcast(known), "_id")
    data = with_statistics(chosen, "_body", ["_id", "quality"]).dropDuplicates(["_id"])
    data = data.withColumns({f: F.expr(e).cast("double") for f, e in FEATURES.items() if f != "n_words"}).orderBy("_id").select(*FEATURES, "quality").toPandas()
    if not len(data):
        return []
    return learn(data, (data["quality"] == 0).to_numpy(), **how)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """True (kept) or false, by the first rule that holds."""
    out = F
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, **how) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document.

    Null texts have no words (and fail). Without labelled rows there are no
    learned rules, and kept is the base rule's. Repeated and null ids and repeated
    rows are ordinary rows; an empty table gives no row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if rules is None:
        rules = fit(rows, labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality"), **how)
    failed = base_failed()
    return with_statistics(rows, "text", ["doc_id"]).select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; see ``assess``."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    # the row is one column, so that its names meet no others
    judged = with_statistics(docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col(text_col).alias("body")), "body", ["row"])
    return judged.where(~base_failed() & verdict(rules)).select("row.*")
