"""Collocations: phrases of two to five words that stand together more than their words' counts explain.

Counting is level-wise. Where a phrase occurs often enough, so do its parts, so
at each level only positions whose first and last ``m - 1`` words are both
frequent are looked at. Their phrases are summed by hash into the level's
candidates, a superset of the frequent ones (the filters of earlier levels may
let too much through, never too little).

All candidates then enter double-array tries, which are broadcast. In each
task, numpy holds the states of all text positions and advances them together,
a word at a time; accepting states are counted by ``bincount``, and the tasks'
counts are summed. These exact counts alone decide the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, tasks

BREAK = b"\xff"  # in no UTF-8 text
#: A-Z in lower case, the ends of pieces as BREAK.
TABLE = bytes(255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words that a task remembers or counts before it hands on or starts anew.
HELD = 500_000
#: Text positions that a task handles at once.
POSITIONS = 2_000_000
#: The filters' bits at most, and phrases of a trie at most (more: several tries, each with a pass of its own).
FILTER_BITS, TRIE_PHRASES = 1 << 27, 250_000
#: States whose counts make one array.
SLICE = 256
#: So many frequent words are broadcast with their numbers; more are told by the filter.
LISTED = 1_000_000
#: An odd multiplier for hashes of phrases (2^64 over the golden ratio).
MULTIPLIER = np.int64(0x9E3779B97F4A7C15 - (1 << 64))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, with BREAK where a piece ends."""
    return text.translate(TABLE).replace(BREAK, b" \xff ").split()


def word_hash(lang: str, word: bytes) -> int:
    """A signed 64-bit hash, not 0."""
    h = xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang.encode())) or 1
    return h - (1 << 64) if h >= 1 << 63 else h


def followed(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases: those of all but the last word, and of the last word."""
    with np.errstate(over="ignore"):
        h = (first ^ (first >> 29)) * MULTIPLIER + word
        h = (h ^ (h >> 32)) * MULTIPLIER
    return np.where(h == 0, 1, h)


class Filter:
    """A bitmap of hashes; what was put in passes, other hashes seldom do."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.mask, self.cells = bits - 1, cells

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.cells[at >> 6] >> (at & 63)) & 1 == 1


def filter_of(tables: list[DataFrame]) -> Filter:
    """Of the ``h`` columns; the bitmap is put together in Spark and has at most FILTER_BITS bits."""
    hashes = tables[0].select("h")
    for t in tables[1:]:
        hashes = hashes.unionAll(t.select("h"))
    bits = 1 << 16
    while bits < min(64 * hashes.count(), FILTER_BITS):
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = hashes.select(F.shiftright(at, 6).alias("cell"), F.expr("shiftleft(1L, CAST(h & 63L AS INT))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    cells = np.zeros(bits >> 6, np.int64)
    cells[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return Filter(bits, cells)


class Listed:
    """Numbers of texts' words from a dictionary; 0 for other words and where a piece ends."""

    def __init__(self, numbers: dict[bytes, int]):
        self.get = numbers.get

    def of(self, text: bytes) -> np.ndarray:
        own = words(text)
        return np.fromiter(map(self.get, own, repeat(0)), np.int64, len(own))


class Found(dict):
    """Numbers of texts' words, found when first met and forgotten when there are too many."""

    def __init__(self, number: Callable[[bytes], int]):
        super().__init__()
        self.number = number
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.number(word)
        return found

    def of(self, text: bytes) -> np.ndarray:
        own = words(text)
        if len(self) > HELD:
            self.clear()
            self[BREAK] = 0
        return np.fromiter(map(self.__getitem__, own), np.int64, len(own))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _positions(batches: Iterator, symbols: Callable[[str], Listed | Found]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, numbers of many texts' words, 0 between texts), about POSITIONS of them at once."""
    known: dict[str, Listed | Found] = {}
    held: dict[str, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    gap = np.zeros(1, np.int64)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in known:
                known[lang] = symbols(lang)
            own = known[lang].of(text)
            held.setdefault(lang, []).extend((own, gap))
            sizes[lang] += len(own) + 1
            if sizes.total() > POSITIONS:
                most = max(sizes, key=sizes.get)
                yield most, np.concatenate(held.pop(most))
                del sizes[most]
    for lang, own in held.items():
        yield lang, np.concatenate(own)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words; word null: their number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[str, Counter] = {}

        def handed(lang: str) -> Iterator:
            own = found.pop(lang)
            own.pop(BREAK, None)
            names = list(own)
            for lo in range(0, len(names), 50_000):
                part = names[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([own[w] for w in part], pa.int64())], names=["lang", "word", "n"]
                )
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.array([own.total()], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words(text))
            while sum(map(len, found.values())) > HELD:
                yield from handed(max(found, key=lambda x: len(found[x])))
        for lang in list(found):
            yield from handed(lang)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashed_words(counted: DataFrame) -> DataFrame:
    """The words' own hashes beside them (lang, phrase, h, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["h"] = np.array([word_hash(lang, w.encode()) for lang, w in zip(b["lang"], b["phrase"], strict=True)], np.int64)
            yield b[["lang", "phrase", "h", "n"]]

    return counted.select("lang", F.col("word").alias("phrase"), "n").mapInPandas(run, "lang string, phrase string, h long, n long")


def level(texts: DataFrame, length: int, levels: list[DataFrame], least: int) -> DataFrame:
    """The candidates of ``length`` words (lang, phrase, h), those whose hashes' counts reach ``least``.

    A text position takes part if both its first and its last ``length - 1``
    words passed the filter of the levels before.
    """
    spark = texts.sparkSession
    listed: dict[str, dict[bytes, int]] | None = None
    if levels[0].count() <= LISTED:
        listed = {}
        for r in levels[0].select("lang", "phrase", "h").toLocalIterator():
            listed.setdefault(r["lang"], {})[r["phrase"].encode()] = r["h"]
    shared = spark.sparkContext.broadcast((filter_of(levels), listed))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frequent, listed = shared.value

        def symbols(lang: str) -> Listed | Found:
            def number(word: bytes) -> int:
                h = word_hash(lang, word)
                return h if frequent.passes(np.array([h]))[0] else 0

            return Found(number) if listed is None else Listed(listed.get(lang, {}))

        for lang, sym in _positions(batches, symbols):
            first = np.flatnonzero(sym)  # where a phrase of the length so far begins, and its hash
            h = sym[first]
            for m in range(2, length + 1):
                both = np.flatnonzero(first[1:] == first[:-1] + 1)
                first, stem = first[both], h[both]
                word = sym[first + m - 1]
                h = followed(stem, word)
                if m < length:
                    fine = frequent.passes(h)
                    first, h = first[fine], h[fine]
            if not len(h):
                continue
            order = np.argsort(h)
            stem, word = stem[order], word[order]
            starts = np.flatnonzero(np.r_[True, (stem[1:] != stem[:-1]) | (word[1:] != word[:-1])])
            n = np.diff(np.r_[starts, len(order)])
            for lo in range(0, len(starts), 100_000):
                own = starts[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(stem[own]), pa.array(word[own]), pa.array(n[lo : lo + 100_000])], names=["lang", "stem", "last", "n"])

    summed = texts.mapInArrow(run, "lang string, stem long, last long, n long").groupBy("lang", "stem", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    stems = levels[-1].select("lang", F.col("h").alias("stem"), F.col("phrase").alias("_stem"))
    lasts = levels[0].select("lang", F.col("h").alias("last"), F.col("phrase").alias("_last"))
    named = stored(summed, f"phrases-{length}").join(stems, ["lang", "stem"]).join(lasts, ["lang", "last"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(h=followed(b["stem"].to_numpy(np.int64), b["last"].to_numpy(np.int64)))[["lang", "phrase", "h"]]

    return named.select("lang", F.concat_ws(" ", "_stem", "_last").alias("phrase"), "stem", "last").mapInPandas(hashed, "lang string, phrase string, h long")


class Trie:
    """Phrases of words as a double array: from state s, word w leads to ``base[s] + w`` if ``check`` there is s.

    The state after one word is the word's number. Numbers are dealt in the
    order of how many phrases a word continues, so that the words after a state
    are mostly near each other. States with many continuations are placed first.
    """

    def __init__(self, phrases: list[tuple[str, str]]):
        split = [(lang, *p.split(" ")) for lang, p in phrases]
        uses = Counter((p[0], w) for p in split for w in p[2:])
        for p in split:
            uses.setdefault((p[0], p[1]), 0)
        number = {w: i for i, (w, _) in enumerate(sorted(uses.items(), key=lambda x: (-x[1], x[0])), 1)}
        self.words: dict[str, dict[bytes, int]] = {}
        for (lang, w), i in number.items():
            self.words.setdefault(lang, {})[w.encode()] = i
        children: dict[tuple, list[int]] = {}
        for p in dict.fromkeys(q[:i] for q in split for i in range(3, len(q) + 1)):
            children.setdefault(p[:-1], []).append(number[p[0], p[-1]])
        self.size = len(number) + 1
        self.base, self.check = np.zeros(2 * self.size, np.int32), np.full(2 * self.size, -1, np.int32)
        self.check[: self.size] = 0
        self.phrase: dict[int, tuple[str, str]] = {}
        state = {p: number[p] for p in children if len(p) == 2}
        back = {}
        wanted = {p: i for i, p in enumerate(split)}
        names = {(lang, i): w for (lang, w), i in number.items()}
        rng = np.random.default_rng(0)
        for depth in range(2, max(map(len, split), default=2)):
            level = sorted((p for p in children if len(p) == depth), key=lambda p: (-len(children[p]), p))
            for p in level:
                codes = np.array(sorted(children[p]), np.int64)
                base = self._room(codes, rng)
                s = state[p]
                self.base[s] = base
                self.check[base + codes] = s
                for c in codes.tolist():
                    q = (*p, names[p[0], c])
                    state[q] = base + c
                    if q in wanted:
                        back[base + c] = wanted[q]
        self.base, self.check = self.base[: self.size].copy(), self.check[: self.size].copy()
        self.phrase = back

    def _room(self, codes: np.ndarray, rng: np.random.Generator) -> int:
        """A base under which all the codes are free: by chance inside, else at the end."""
        low = self.size - int(codes[-1])
        if low > 0:
            for base in rng.integers(0, low, 24).tolist():
                if (self.check[base + codes] < 0).all():
                    return base
        base = self.size - int(codes[0])
        self.size = base + int(codes[-1]) + 1
        if self.size > len(self.check):
            more = max(self.size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
        return base

    def counts(self, sym: np.ndarray, into: np.ndarray) -> None:
        """Adds how often each state is reached, from all positions at once."""
        at = np.flatnonzero(sym)
        state = sym[at]
        depth = 1
        while len(at):
            inside = at + depth < len(sym)
            at, state = at[inside], state[inside]
            word = sym[at + depth]
            to = self.base[state] + word
            fine = (word > 0) & (to < len(self.check))
            fine[fine] = self.check[to[fine]] == state[fine]
            at, state = at[fine], to[fine]
            into += np.bincount(state, minlength=len(into))
            depth += 1


def trie_counts(texts: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """(lang, phrase, a): how often each of the phrases occurs.

    A task hands on its counts as a few arrays (SLICE states each) and the tasks'
    arrays are added as they stream by, so there is no row for each phrase and task.
    """
    spark = texts.sparkSession
    trie = Trie(phrases)
    listed = sorted(trie.phrase.items())
    states = np.array([s for s, _ in listed], np.int64)
    named = [phrases[i] for _, i in listed]
    trie.phrase = {}
    shared = spark.sparkContext.broadcast((trie, states, named))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie, states, _ = shared.value
        total = np.zeros(len(trie.check), np.int64)
        for _, sym in _positions(batches, lambda lang: Listed(trie.words.get(lang, {}))):
            trie.counts(sym, total)
        own = total[states]
        cuts = [lo for lo in range(0, len(own), SLICE) if own[lo : lo + SLICE].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([lo // SLICE for lo in cuts], pa.int64()), "counts": pa.array([own[lo : lo + SLICE].tobytes() for lo in cuts], pa.binary())})

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        named, sums = shared.value[2], {}
        for batch in batches:
            for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                sums[at] = sums[at] + own if at in sums else own
        for at, own in sums.items():
            langs, listed = zip(*named[at * SLICE : at * SLICE + len(own)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(listed), pa.array(own)], names=["lang", "phrase", "a"])

    shards = texts.mapInArrow(count, "slice long, counts binary")
    return shards.repartition(tasks(spark), "slice").mapInArrow(add, "lang string, phrase string, a long")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, lang_col: str = "lang", text_col: str = "text", trie_phrases: int = TRIE_PHRASES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` collocations.

    A phrase inside a longer one that occurs in at least ``share`` hundredths of
    its places is left to the longer one. Null texts are empty, a null language
    is ``und``. Repeated rows count each; equal scores go by count, then UTF-8.
    An empty table gives no row; other columns are ignored.

    Tasks hold POSITIONS text positions, HELD words, one trie. The driver holds
    one trie of at most ``trie_phrases`` phrases at a time and the filter.
    """
    texts = _texts(docs, lang_col, text_col)
    counted = word_counts(texts)
    counted = stored(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "phrase-words")
    sizes = counted.where("word IS NULL").select("lang", F.col("n").alias("size"))
    levels = [stored(hashed_words(counted.where("word IS NOT NULL")), "phrases-1")]
    for length in range(2, longest + 1):
        found = stored(level(texts, length, levels, least), f"phrases-{length}")
        if found.isEmpty():
            break
        levels.append(found)

    frequent = levels[0].select("lang", "phrase", F.col("n").alias("a"))
    candidates = None
    for found in levels[1:]:
        candidates = found.select("lang", "phrase") if candidates is None else candidates.unionAll(found.select("lang", "phrase"))
    if candidates is not None:
        tries = -(-candidates.count() // trie_phrases)
        first_two = F.substring_index("phrase", " ", 2)
        dealt = candidates.withColumn("_trie", F.pmod(F.xxhash64("lang", first_two), F.lit(tries)))
        for i in range(tries):
            own = [(r["lang"], r["phrase"]) for r in dealt.where(F.col("_trie") == i).select("lang", "phrase").toLocalIterator()]
            exact = trie_counts(texts, sorted(own)).where(F.col("a") >= least) if own else None
            if exact is not None:
                frequent = frequent.unionAll(stored(exact, "phrase-counts"))
    frequent = frequent.withColumn("_w", F.split("phrase", " ")).withColumn("_m", F.size("_w"))

    part = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    known = frequent.select("lang", "phrase", "a")
    longer = frequent.where("_m > 2")
    inner = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("_m") - 1), part(F.lit(2), F.col("_m") - 1))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = frequent.where("_m > 1").join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "_w", "_m", F.explode(F.sequence(F.lit(1), F.col("_m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_first"), part(F.col("k") + 1, F.col("_m") - F.col("k")).alias("_rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_first"), F.col("a").alias("l")), ["lang", "_first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_rest"), F.col("a").alias("r")), ["lang", "_rest"]).join(F.broadcast(sizes), "lang")
    score = F.expr("(CAST(a AS DECIMAL(18)) * CAST(1000 * size AS DECIMAL(19))) DIV (CAST(l AS DECIMAL(18)) * CAST(r AS DECIMAL(18)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("size").alias("n"))).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    first = best.withColumn("_some", F.row_number().over(some)).where(F.col("_some") <= top).drop("_some")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same by counting every phrase of every text."""
    return """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS ws, count(*) AS a FROM x, range(1, 6) t(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY ALL),
inner_ AS (SELECT lang, unnest([list_slice(ws, 1, m - 1), list_slice(ws, 2, m)]) AS ws, a FROM f WHERE m > 2),
c AS (SELECT f.*, unnest(range(1, m)) AS k FROM f LEFT JOIN (SELECT lang, ws, max(a) AS b FROM inner_ GROUP BY ALL) i USING (lang, ws)
    WHERE m > 1 AND (b IS NULL OR 100 * b < 100 * f.a)),
s AS (SELECT c.lang, c.ws, c.k, c.a, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
    FROM c JOIN f l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, k) JOIN f r ON r.lang = c.lang AND r.ws = list_slice(c.ws, k + 1, c.m) JOIN n ON n.lang = c.lang),
b AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM b QUALIFY rank <= 2000"""
