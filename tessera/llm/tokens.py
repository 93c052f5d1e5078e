"""Token counts by rank-synchronous array merging.

Texts are cut at white space; the parts that a worker has not met before are
pre-tokenised and held as one ragged numpy array of symbols. Each round finds
every pre-token's lowest-ranked adjacent pair and merges all its occurrences in
all pre-tokens at once; the symbols that survive are the tokens.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of texts of up to so many characters are remembered, up to so many of them; then a worker starts anew.
REMEMBERED, MEMO = 64, 500_000
#: Pre-tokens of more symbols are merged by themselves.
LONG = 256
#: Code points up to here have no canonical composition and simple lower case.
SIMPLE = "\u024f"
#: Only these are white space to str.split() but not to the tokenizer.
ODD_SPLIT = regex.compile("[\x1c-\x1f]")


class Vocabulary:
    """What the merging needs of a byte-level BPE with word ends, from its .json file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.special_split = regex.compile(f"({self.special_re.pattern})")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        symbols = self._byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in symbols], dtype=np.int64)
        keys, made = [], []
        for rank, (a, b) in enumerate(model["merges"]):
            keys.append((vocab[a] << 32) | vocab[b])
            made.append((rank, vocab[a + b]))
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks, self.merged = np.array(made, dtype=np.int64)[order].T.copy()

    @staticmethod
    def _byte_symbols() -> list[str]:
        """The character by which byte-level BPE files write each byte: printable ones stand for themselves."""
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = iter(range(256, 512))
        return [chr(b) if b in kept else chr(next(others)) for b in range(256)]

    def pretokens(self, part: str) -> list[bytes]:
        """The pre-tokens of a text without special tokens, as UTF-8 bytes."""
        if part.isascii() or max(part) <= SIMPLE:
            low = part.lower()
            if low.isalpha() and "İ" not in part:
                return [low.encode()]
            if low[:-1].isalpha() and low[-1] in ".,;:!?" and "İ" not in part:
                return [low[:-1].encode(), low[-1].encode()]
            found = self.words.findall("".join(c.lower() for c in part) if "İ" in part else part.lower())
        else:
            whole = self.library.normalizer.normalize_str(part)
            found = [whole[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        return [w.encode() for w in found]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (not empty) pre-tokens in a row, and how many each has."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._merge_short(words)
        ids, counts = self._merge_short([w if len(w) <= LONG else b"" for w in words])
        cuts = np.cumsum(counts)[long] - counts[long]
        parts, at = [], 0
        for i, cut in zip(long, cuts.tolist(), strict=True):
            own = self._merge_long(words[i])
            counts[i] = len(own)
            parts += [ids[at:cut], own]
            at = cut
        return np.concatenate([*parts, ids[at:]]), counts

    @functools.cached_property
    def pair_ranks(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One pre-token, rank by rank: all places of the lowest rank merge, and only what stands beside them is ranked anew."""
        data = np.frombuffer(word, dtype=np.uint8)
        sym = [*self.inner[data[:-1]].tolist(), int(self.last[data[-1]])]
        ranks, n = self.pair_ranks, len(sym)
        after, prior = [*range(1, n), -1], [-1, *range(n - 1)]
        places: dict[int, list[int]] = {}
        heap: list[int] = []

        def rank(i: int) -> None:
            hit = ranks.get((sym[i] << 32) | sym[after[i]])
            if hit is not None:
                if hit[0] not in places:
                    places[hit[0]] = []
                    heapq.heappush(heap, hit[0])
                places[hit[0]].append(i)

        for i in range(n - 1):
            rank(i)
        while heap:
            r = heapq.heappop(heap)
            for i in sorted(places.pop(r)):
                j = after[i]
                if sym[i] < 0 or j < 0:
                    continue
                hit = ranks.get((sym[i] << 32) | sym[j])
                if hit is None or hit[0] != r:
                    continue
                sym[i], sym[j], after[i] = hit[1], -1, after[j]
                if after[i] >= 0:
                    prior[after[i]] = i
                    rank(i)
                if prior[i] >= 0:
                    rank(prior[i])
        return np.array([x for x in sym if x >= 0], dtype=np.int64)

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pre-tokens at once; an empty one has no id."""
        counts = np.zeros(len(words), dtype=np.int64)
        ready = []
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys) + 1
        while len(symbols):
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)  # the last symbol starts no pair
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = best == none
            counts[owner[starts[done]]] = sizes[done]
            hit = (rank == np.repeat(best, sizes)) & (rank < none)
            # in a run of overlapping hits ("aaaa") every second one merges, from the left
            idx = np.flatnonzero(hit)
            if len(idx):
                fresh = np.r_[True, np.diff(idx) != 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(idx)), 0))
                idx = idx[(np.arange(len(idx)) - run) % 2 == 0]
                symbols[idx] = self.merged[at[idx]]
            keep = np.repeat(~done, sizes)
            ready.append((owner[~keep], symbols[~keep]))
            keep[idx + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not ready:
            return np.zeros(0, dtype=np.int64), counts
        owner, symbols = (np.concatenate(x) for x in zip(*ready, strict=True))
        return symbols[np.argsort(owner, kind="stable")], counts


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo:
    """What a worker knows of the parts of texts it has met, part by part."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[str, int | bytes] = {}
        self.passing: list[str] = []

    def merged(self, parts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """For each part its pre-tokens' numbers (below 0: a special token's), and all pre-tokens' ids and counts."""
        words: dict[bytes, int] = {}
        plan = []
        for part in parts:
            if "<|" in part and self.vocab.special_re.search(part):
                own = []
                for piece in self.vocab.special_split.split(part):
                    if piece in self.vocab.special:
                        own.append(-1 - self.vocab.special[piece])
                    elif piece:
                        own += [words.setdefault(w, len(words)) for w in self.vocab.pretokens(piece)]
            else:
                own = [words.setdefault(w, len(words)) for w in self.vocab.pretokens(part)]
            plan.append(own)
        return plan, *self.vocab.merge(list(words))

    def learn(self, parts: list[str]) -> None:
        raise NotImplementedError

    def look_up(self, texts: list[str]) -> list[list[str]]:
        """The parts of the texts, all known until the next call."""
        for part in self.passing:
            self.known.pop(part, None)
        cut = [[t] if ODD_SPLIT.search(t) else t.split() for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        known = self.known
        if new := {p for parts in cut for p in parts if p not in known}:
            self.learn(list(new))
        self.passing = [p for p in new if len(p) > REMEMBERED]
        return cut


class Counter(Memo):
    """Counts the tokens of texts."""

    def learn(self, parts: list[str]) -> None:
        plan, _, counts = self.merged(parts)
        counts = counts.tolist()
        self.known.update((part, sum([counts[w] if w >= 0 else 1 for w in own])) for part, own in zip(parts, plan, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        get = self.known.__getitem__
        return [sum(map(get, parts)) for parts in self.look_up(texts)]


class Encoder(Memo):
    """The ids of texts as little-endian uint32 bytes."""

    def learn(self, parts: list[str]) -> None:
        plan, ids, counts = self.merged(parts)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        starts = [0, *ends]
        for part, own in zip(parts, plan, strict=True):
            self.known[part] = b"".join([data[starts[w] : ends[w]] if w >= 0 else (-1 - w).to_bytes(4, "little") for w in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in self.look_up(texts)]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker's own, so that what one task learns serves the next."""
    return Counter(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def in_batches(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in runs of about so many characters, of one text at least."""
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= chars):
            total += len(texts[upto])
            upto += 1
        yield texts[at:upto]
        at = upto


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4_000_000
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    ``path`` is the tokenizer's file, readable on every executor. Null texts are
    empty (0 bytes, 0 tokens); repeated rows are counted one by one; an empty
    table gives no row; other columns are ignored. No shuffle; memory is bounded
    by a batch, the longest text and the remembered parts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = counter(path).count
        for batch in batches:
            counts = [n for texts in in_batches(batch.column("text").to_pylist(), batch_chars) for n in count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
