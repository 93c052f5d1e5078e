"""Secret scans: fixed rules, and a character convolutional network in numpy.

Every candidate (a run of 12 or more characters of keys with a digit, or with a
capital after a small letter) is read with its surrounding context. The network is
trained on labelled findings: candidates that the rules find are secrets; others are
not, but those of a key's shape, which are what the network is to judge, have no
label. In half of the training windows the word that the rules go by is replaced by
letters, so that shape and context count without it. All labelled windows of the
corpus take part: blocks of them are trained on side by side, and the blocks' networks
are averaged after each pass. Scores are calibrated on all of a
held-out part, which shares no candidate with the rest, and the threshold is the
highest at which the wanted share of the held-out findings is still found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: The rules' kinds in order, and their patterns.
KINDS = ("assign", "access", "hex")
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a run that is long enough, from its start: the same as longest runs less the short ones
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
DIGIT = re.compile(r"[0-9]")
#: What a candidate must hold.
KEYED = re.compile(r"[0-9]|[a-z][A-Z]")
#: A candidate that looks like a key: letters and digits in one run.
SHAPED = re.compile(r"(?=.*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
_NAME = re.compile(_NAMES)

BEFORE, WIDTH, AFTER = 20, 48, 4
#: Scores are rounded to steps of 1/64 between these bounds, so that their counts are a short table.
STEP, STEPS = 64, 64 * 64
#: Windows of a block: one task's part in a pass.
BLOCK = 12_000
ALPHABET = 40
_CODES = np.full(256, 1, dtype=np.int8)
for _i, _c in enumerate("0123456789"):
    _CODES[ord(_c)] = 2 + _i % 10
for _c in "abcdef":
    _CODES[ord(_c)] = 12 + ord(_c) - 97
for _c in "ghijklmnopqrstuvwxyz":
    _CODES[ord(_c)] = 18
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CODES[ord(_c)] = 19
for _i, _c in enumerate(" \n=:\"'+/_.-@()#*,;%$&"):
    _CODES[ord(_c)] = 20 + _i % 20


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if DIGIT.search(text) or re.search("[a-f]{24}", text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if KEYED.search(m.group())]


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its context, in overlapping pieces where it is long."""
    cut = []
    for at in range(start, max(end - WIDTH // 2, start + 1), WIDTH // 2):
        upto = min(at + WIDTH, end)
        cut.append(text[max(0, at - BEFORE) : at].rjust(BEFORE) + text[at:upto].ljust(WIDTH) + text[upto : upto + AFTER].ljust(AFTER))
    return cut


def coded(strings: list[str]) -> np.ndarray:
    """The windows as rows of small codes, the place of the candidate kept."""
    raw = "".join(s for s in strings).encode("latin-1", "replace")
    return _CODES[np.frombuffer(raw, dtype=np.uint8)].reshape(len(strings), BEFORE + WIDTH + AFTER)


@dataclass
class Network:
    """Embedding, one convolution over five characters, maxima over context and candidate, a logistic unit."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    #: On the held-out windows, at the threshold.
    recall: float = 0.0
    precision: float = 0.0

    @classmethod
    def fresh(cls, seed: int, dim: int = 8, filters: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (ALPHABET, dim)), rng.normal(0, 0.3, (5 * dim, filters)), np.zeros(filters), rng.normal(0, 0.3, 2 * filters), np.zeros(1))

    def forward(self, x: np.ndarray):
        e = self.emb[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, 5, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, 5 * e.shape[2])
        h = np.maximum(cols @ self.conv + self.bias, 0)
        left, right = h[:, : BEFORE - 2], h[:, BEFORE - 2 :]
        at = np.concatenate([left.argmax(1), right.argmax(1) + BEFORE - 2], axis=1)
        both = np.concatenate([left.max(1), right.max(1)], axis=1)
        return cols, at, both, both @ self.out + self.shift[0]

    def steps(self, x: np.ndarray) -> np.ndarray:
        """The scores in whole steps."""
        z = np.concatenate([self.forward(x[i : i + 2048])[3] for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)
        return np.clip(np.rint(z * STEP), -STEPS, STEPS).astype(np.int64)

    def likely(self, steps: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * steps / STEP + self.offset, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.likely(self.steps(x))

    def parameters(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.emb, self.conv, self.bias, self.out, self.shift)])

    def assume(self, flat: np.ndarray) -> None:
        """Takes the values that ``parameters`` gave."""
        at = 0
        for p in (self.emb, self.conv, self.bias, self.out, self.shift):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def train(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int, share: float, rate: float = 0.01) -> None:
        """``share`` is that of the findings in all blocks."""
        rng = np.random.default_rng(seed)
        params = [self.emb, self.conv, self.bias, self.out, self.shift]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        filters = len(self.bias)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                b = order[i : i + 128]
                cols, at, both, z = self.forward(x[b])
                dz = weight[b] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
                dboth = dz[:, None] * self.out * (both > 0)
                rows = np.arange(len(b))[:, None]
                picked = cols[rows, at]  # example, unit, 5 * dim
                g = np.einsum("bu,bud->ud", dboth, picked)
                dconv = (g[:filters] + g[filters:]).T
                dbias = dboth.sum(0)[:filters] + dboth.sum(0)[filters:]
                kernels = np.concatenate([self.conv, self.conv], axis=1).T
                dcols = (dboth[:, :, None] * kernels).reshape(len(b), 2 * filters, 5, -1)
                demb = np.zeros_like(self.emb)
                np.add.at(demb, x[b][rows[:, :, None], at[:, :, None] + np.arange(5)], dcols)
                t += 1
                for p, grad, mm, vv in zip(params, (demb, dconv, dbias, both.T @ dz, dz.sum(keepdims=True)), m, v, strict=True):
                    mm += 0.1 * (grad - mm)
                    vv += 0.001 * (grad**2 - vv)
                    p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, steps: np.ndarray, y: np.ndarray, times: np.ndarray, recall: float) -> None:
        """Platt scaling from the counts of scores; then the highest threshold that keeps ``recall`` of the findings. Precision is only reported."""
        z, w = steps / STEP, times / times.sum()
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 0.05 * np.sum(w * (p - y) * z)
            b -= 0.05 * np.sum(w * (p - y))
        self.scale, self.offset = float(a), float(b)
        found = y == 1
        order = np.argsort(-steps[found])
        reached = np.cumsum(times[found][order])
        least = steps[found][order][np.searchsorted(reached, recall * reached[-1] - 1e-9)]
        # between two steps, so that the last digits of a score decide nothing
        self.threshold = float(self.likely(np.array([least - 0.5]))[0])
        hit = self.likely(steps) >= self.threshold
        self.recall, self.precision = float(times[hit & found].sum() / times[found].sum()), float(times[hit & found].sum() / times[hit].sum())


def _unnamed(text: str, start: int, end: int, hits: list[tuple[int, int, int]]) -> str:
    """The text with the words of an assignment around a candidate replaced by letters that follow from the candidate."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(text[start:end].encode()).digest()[:4], "big"))
    for a, kind, b in hits:
        if kind == 0 and a < end and start < b:
            n = _NAME.match(text, a).end() - a
            text = text[:a] + "".join(map(chr, rng.integers(97, 123, n))) + text[a + n :]
    return text


def labelled(text: str) -> list[tuple[int, str, str]]:
    """(label, candidate, window) for each candidate of a text that has a label; the windows of findings also without the rule's word."""
    hits = base_findings(text)
    out = []
    for a, b in candidates(text):
        own = text[a:b]
        if any(s < b and a < e for s, _, e in hits):
            bare = _unnamed(text, a, b, hits)
            out += [(1, own, w) for w in windows(text, a, b)]
            out += [(1, own, w) for w in windows(bare, a, b)] if bare != text else []
        elif not SHAPED.fullmatch(own):
            out += [(0, own, w) for w in windows(text, a, b)]
    return out


def fit(docs: DataFrame, seed: int = 7, epochs: int = 6, recall: float = 0.98, text_col: str = "text", block: int = BLOCK) -> Network | None:
    """The network, fitted on all labelled windows.

    A quarter of the candidates, by hash, is held out. The windows of the rest, copies included, are trained on once a pass,
    in blocks of about ``block`` by hash; after each pass the blocks' networks are averaged. A block's
    network (1,009 numbers) and the counts of the held-out windows' scores are what reaches the driver.
    None where a label has no candidate
    on one of the two sides: then nothing can be learned, and the result is the rules' alone.
    """
    rows = docs.where(F.col(text_col).rlike("[0-9]|[a-z][A-Z]")).select(F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [x for t in batch.column("text").slice(at, 500).to_pylist() for x in labelled(t)]
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["label", "own", "window"])

    held = F.pmod(F.xxhash64(F.lit(seed), "own"), F.lit(4)) == 0
    every = rows.mapInArrow(run, "label int, own string, window string").select("label", "window", held.alias("held"))
    found = stored(every.groupBy("label", "window", "held").agg(F.count(F.lit(1)).alias("times")), "windows")
    sizes = {(r["label"], r["held"]): r["n"] for r in found.groupBy("label", "held").agg(F.sum("times").alias("n")).collect()}
    if len(sizes) < 4:
        return None
    n, blocks = sum(sizes.values()), -(-sum(sizes.values()) // block)
    share = sizes[1, False] / (sizes[0, False] + sizes[1, False])
    # copies of a window go to different blocks
    copies = found.select("label", "window", "held", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    dealt = copies.select("label", "window", "held", F.xxhash64("window").alias("mark"), F.pmod(F.xxhash64(F.lit(seed), "window", "copy"), F.lit(blocks)).alias("block"))
    net = Network.fresh(seed)
    # few windows are gone through more often; a single block needs no averaging between its passes
    passes = max(epochs, -(-600 * epochs // n))
    rounds = passes if blocks > 1 else 1
    for turn in range(rounds):
        parts = dealt.groupBy("block").applyInArrow(_trained(net, seed, turn, passes // rounds, share), "block long, n long, p array<double>").collect()
        parts.sort(key=lambda r: r["block"])
        net.assume(np.average([r["p"] for r in parts], axis=0, weights=[r["n"] for r in parts]))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            steps = net.steps(coded(batch.column("window").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("times"), pa.array(steps)], names=["label", "times", "step"])

    scores = found.where("held").select("label", "times", "window").mapInArrow(score, "label int, times long, step long")
    table = np.array([tuple(r) for r in scores.groupBy("label", "step").agg(F.sum("times")).orderBy("label", "step").collect()], dtype=np.int64)
    net.calibrate(table[:, 1], table[:, 0].astype(float), table[:, 2], recall)
    return net


def _trained(start: Network, seed: int, turn: int, passes: int, share: float):
    """A block's network after ``passes`` through its windows, from ``start``."""

    def run(table):
        import pyarrow as pa

        data = table.sort_by([("label", "ascending"), ("mark", "ascending"), ("window", "ascending"), ("held", "ascending")]).to_pandas().sample(frac=1, random_state=seed)
        own = data[~data["held"]]
        net = Network.fresh(0)
        net.assume(start.parameters())
        if len(own):
            net.train(coded(own["window"].tolist()), own["label"].to_numpy().astype(float), seed + turn, passes, share)
        return pa.table({"block": table.column("block").slice(0, 1), "n": [len(own)], "p": [net.parameters().tolist()]})

    return run


def outside(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans, in order, that no base span overlaps."""
    out, i, reach = [], 0, 0
    for a, b in spans:
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" if k < len(KINDS) else f"model:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model of every whole text.

    Spans of the network (kind ``model``) are candidates over the threshold that
    no base span overlaps. Null texts are empty; repeated and null ids and
    repeated rows are ordinary rows; an empty table gives no row; other columns
    are ignored. No shuffle; memory is bounded by a batch and the longest text.
    """
    net = network or fit(docs, text_col=text_col, **how)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bases, cuts, owner = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base = base_findings(text)
                bases.append(base)
                if net is None:
                    continue
                for a, b in outside(candidates(text), base):
                    own = windows(text, a, b)
                    cuts += own
                    owner += [(i, a, b)] * len(own)
            added: dict[int, set] = {}
            if cuts:
                for (i, a, b), p in zip(owner, net.probability(coded(cuts)), strict=True):
                    if p >= net.threshold:
                        added.setdefault(i, set()).add((a, len(KINDS), b))
            counts = [[sum(k == j for _, k, _ in base) for base in bases] for j in range(len(KINDS))]
            shas = [hashlib.sha256(named(base).encode()).hexdigest() for base in bases]
            spans = [named(sorted([*base, *added.get(i, ())])) for i, base in enumerate(bases)]
            more = [len(added.get(i, ())) for i in range(len(bases))]
            columns = [*[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
