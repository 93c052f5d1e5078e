"""SentencePiece (BPE) encoding and decoding, with a max-plus parallel scan for giant documents.

A BPE segmentation is a path that can be checked from neighbour to neighbour: two
pieces fit if their joined text is segmented into just these two, and a sequence of
pieces is the segmentation of its text if and only if all neighbours fit. (Take the
first merge, in the order of merges, that crosses two pieces of a sequence: until
then each piece has merged by itself, so the same merge crosses them in the text of
those two alone.) So a step has weight 0 if it fits the piece before, and minus
infinity otherwise; just one path to each place has weight 0, and it is the library's.

A giant document is cut into chunks at any characters. The states at a cut are the
pieces of the text there that begin before it and end at or after it. A chunk's
transfer matrix has the best weight from each state at its start to each at its end;
matrices combine by max-plus products, which are associative, so blocks of chunks
are combined by themselves, then the blocks. Down again, the state at each cut
follows, and every chunk is traced back by itself between its two states.

No piece holds a blank after another character, nor a line break beside another, so
every path passes such a place: there a chunk's matrix is of rank one, and what stands
between two such places (mostly one word) has one segmentation, which a worker remembers.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

BLANK = "▁"
#: Weight of a step that does not fit.
LOW = -np.inf
#: Segments of up to so many characters are remembered, up to so many of them, and so many pairs of pieces.
REMEMBERED, MEMO, PAIRS = 64, 500_000, 500_000
#: Chunks in a block: with cells of at most 2 GB, neither a block nor a document has more than a few hundred matrices.
BLOCK = 256

State = tuple[str | None, int]


class Model:
    """The pieces of a BPE model file with byte fallback, as the library reads them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.texts[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        byte_ids = {b: i for i, b in self.bytes.items()}
        self.byte_ids = [byte_ids[b] for b in range(256)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in plain}
        self.scores = {self.texts[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.scores))
        #: Pieces (True) and what only begins pieces (False).
        self.begun = {p[:n]: False for p in self.scores for n in range(1, len(p))} | dict.fromkeys(self.scores, True)
        #: No piece crosses the place before a blank that follows another character.
        self.pinched = not any(BLANK in p.lstrip(BLANK) for p in self.scores)
        # line breaks and the like that no longer piece holds stand by themselves
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        #: What stands between two pinches: blanks and what follows them; a character by itself.
        self.segments = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else ""))
        #: Two characters with a pinch between them.
        self.pinch = re.compile(f"[^{BLANK}](?={BLANK})" + (f"|[{alone}](?=.)|.(?=[{alone}])" if alone else ""), re.DOTALL)
        self.pairs: dict[str | None, dict[str, bool]] = {}
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        #: Segments whose ids decode to another text (none is known).
        self.unfaithful: set[str] = set()

    @staticmethod
    def marked(text: str) -> str:
        """The text as the pieces see it: one blank before it, and blanks made visible."""
        return BLANK + text.replace(" ", BLANK) if text else ""

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best score first, the leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str | None, b: str) -> bool:
        """Whether ``b`` may follow ``a`` (None: the start of a text)."""
        own = self.pairs.setdefault(a, {})
        if (known := own.get(b)) is None:
            if self.n_pairs > PAIRS:
                self.pairs, self.n_pairs = {}, 0
                own = self.pairs.setdefault(a, {})
            known = own[b] = self.merged(b) == [b] if a is None else self.merged(a + b) == [a, b]
            self.n_pairs += 1
        return known

    # -- paths -----------------------------------------------------------------

    def reached(self, s: str, first: int, end: int, before: str | None, like: list[str | None] | None = None) -> list[str | None]:
        """For each place from ``first`` on, the last piece of the path of weight 0 to it (pieces start before ``end``).

        Paths that agree over as many places as the longest piece stay the same: the
        rest is then taken from ``like``, an earlier result that ended at the same place.
        """
        longest, begun, fits, none = self.longest, self.begun, self.fits, {}
        back: list[str | None] = [None] * (end - first + longest)
        back[0] = before
        shift, same = len(like) - len(back) if like is not None else 0, 0
        size = len(s)
        for at in range(end - first):
            a = back[at]
            if like is not None:
                same = same + 1 if at + shift >= 0 and a is not None and like[at + shift] == a else 0
                if same > longest:
                    return back[:at] + like[at + shift :]
            if a is None and at:
                continue
            start, own = first + at, self.pairs.get(a, none)
            for stop in range(start + 1, min(start + longest, size) + 1):
                t = s[start:stop]
                kind = begun.get(t)
                if kind or stop == start + 1:
                    fine = own.get(t)
                    if fits(a, t) if fine is None else fine:
                        back[stop - first] = t
                if kind is None:
                    break
        return back

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def trace(self, s: str, first: int, last: int, before: str | None) -> list[str]:
        """The pieces between two places on the path of weight 0, after the piece ``before``.

        The longest fitting piece is tried first. A place from which the end was not
        reached is not tried again (just one path leads to it), so this takes linear time.
        """
        out, at, a, dead, left = [], first, before, set(), []
        fits, pairs, none, longest, kind_of = self.fits, self.pairs, {}, self.longest, self.begun.get
        while at < last:
            # the pieces that start here, the longest at the end; an unknown character is one
            t = s[at : at + 1]
            tried, kind = [t], kind_of(t)
            for stop in range(at + 2, min(at + longest, last) + 1):
                if kind is None:
                    break
                t = s[at:stop]
                kind = kind_of(t)
                if kind:
                    tried.append(t)
            while True:
                own = pairs.get(a, none)
                while tried:
                    t = tried.pop()
                    fine = own.get(t)
                    if (fits(a, t) if fine is None else fine) and at + len(t) not in dead:
                        break
                else:
                    if not out:
                        raise ValueError("no path of weight 0")
                    dead.add(at)
                    at -= len(out.pop())
                    a, tried = out[-1] if out else before, left.pop()
                    continue
                break
            out.append(t)
            left.append(tried)
            at, a = at + len(t), t
        return out

    def pinches(self, s: str, start: int, end: int) -> tuple[int, int] | None:
        """The first and the last place inside (start, end) that all paths pass."""
        found = self.pinch.search(s, start, end - 1) if self.pinched else None
        if found is None:
            return None
        at = end - 1
        while not self.pinch.match(s, at - 1):
            at -= 1
        return found.start() + 1, at

    # -- transfer matrices -------------------------------------------------------

    def states(self, s: str, at: int) -> list[State]:
        """(piece, how far it reaches over the place) of the pieces that begin before a place and end at or after it."""
        found = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(start + self.longest, len(s)) + 1):
                if (end - start == 1 or s[start:end] in self.scores) and self.fits(None, s[start:end]):
                    found.append((s[start:end], end - at))
        return found

    def transfer(self, s: str, start: int, end: int, ins: list[State], outs: list[State]) -> np.ndarray:
        """Best weight from each state at ``start`` to each at ``end``."""
        place = {x: i for i, x in enumerate(outs)}
        out = np.full((len(ins), len(outs)), LOW, dtype=np.float32)

        def arrived(back: list[str | None], first: int) -> list[int]:
            ends = enumerate(back[max(end - first, 0) :], max(first - end, 0))
            return [place[x, over] for over, x in ends if x is not None and (x, over) in place]

        cut, like = self.pinches(s, start, end), None
        tail = arrived(self.reached(s, cut[1], end, None), cut[1]) if cut else []
        for i, (piece, over) in enumerate(ins):
            first = start + over
            if first >= end:  # the piece reaches over the whole chunk
                out[i, [place[x] for x in [(piece, first - end)] if x in place]] = 0.0
            elif cut:
                if first == cut[0] or (first < cut[0] and self.reached(s, first, cut[0], piece)[cut[0] - first] is not None):
                    out[i, tail] = 0.0
            else:
                back = self.reached(s, first, end, piece, like)
                out[i, arrived(back, first)] = 0.0
                if any(x is not None for x in back[end - first :]):
                    like = back
        return out

    # -- words and whole texts ---------------------------------------------------

    def segment(self, part: str) -> bytes:
        """The ids of what stands between two pinches, as bytes."""
        ids = self.ids_of(self.trace(part, 0, len(part), None))
        data = array("I", ids).tobytes()
        if self.joined(ids) != part:
            self.unfaithful.add(part)
        if len(part) <= REMEMBERED:
            if len(self.known) > MEMO:
                self.known.clear()
            self.known[part] = data
        return data

    def between(self, s: str, first: int, last: int, before: str | None) -> tuple[bytes, bool]:
        """The ids of the path between two places, as bytes, and whether they decode to the text there."""
        data, fine, at = b"", True, first
        if first < last and not (self.pinched and (before is None or self.pinch.match(s, first - 1))):
            cut = self.pinches(s, first, last)
            at = cut[0] if cut else last
            ids = self.ids_of(self.trace(s, first, at, before))
            data, fine = array("I", ids).tobytes(), self.joined(ids) == s[first:at]
        parts, get = self.segments.findall(s, at, last), self.known.get
        data += b"".join([get(p) or self.segment(p) for p in parts])
        return data, fine and (not self.unfaithful or self.unfaithful.isdisjoint(parts))

    def joined(self, ids: list[int]) -> str:
        """The text of the ids with blanks visible: byte pieces give bytes."""
        texts, raw = self.texts, self.bytes
        if raw.keys().isdisjoint(ids):
            return "".join([texts[i] for i in ids])
        return b"".join(bytes([raw[i]]) if i in raw else texts[i].encode() for i in ids).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: blanks are spaces, the first blank goes."""
        text = self.joined(ids).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states_between(mats: list[np.ndarray], first: int, last: int | None) -> list[int]:
    """The state at each boundary on the best path from ``first`` to ``last`` (None: any at the end)."""
    suffix = np.zeros(mats[-1].shape[1], dtype=np.float32)
    if last is not None:
        suffix[:] = LOW
        suffix[last] = 0.0
    behind = [suffix]
    for m in reversed(mats[1:]):
        behind.append((m + behind[-1][None, :]).max(axis=1))
    states = [first]
    for m, rest in zip(mats, reversed(behind), strict=True):
        states.append(int(np.argmax(m[states[-1]] + rest)))
    return states


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


# -- checksums of parts ------------------------------------------------------------

def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@functools.cache
def _zeros(power: int) -> list[int]:
    """The effect of 2^power zero bytes on a checksum, as a matrix over bits."""
    if power < 0:  # one zero bit
        return [0xEDB88320, *[1 << i for i in range(31)]]
    m = _zeros(power - 1)
    for _ in range(3 if power == 0 else 1):
        m = [_times(m, x) for x in m]
    return m


def shifted_crc(crc: int, n: int) -> int:
    """The part of a joined text's CRC-32 that comes from a part with this CRC-32 and n bytes after it."""
    power = 0
    while n:
        if n & 1:
            crc = _times(_zeros(power), crc)
        n >>= 1
        power += 1
    return crc


# -- Spark -------------------------------------------------------------------------

CHUNK = "_row long, doc_id long, k int, n int, before string, body string, after string"
SUMS = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, decoded_equal boolean"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _arrow(columns: dict, schema: str):
    """A record batch of these lists; ``schema`` has long, int, string, binary and boolean columns."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in named], names=[n for n, _ in named])


def _whole(rows: DataFrame, path: str) -> DataFrame:
    """Documents of one chunk, each in its place."""

    def run(batches: Iterator) -> Iterator:
        m = model(path)
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in SUMS.split(", ")}
            for text in batch.column("text").to_pylist():
                s = m.marked(text)
                data, fine = m.between(s, 0, len(s), None)
                out["n_chars"].append(len(text))
                out["n_pieces"].append(len(data) // 4)
                out["ids_crc32"].append(zlib.crc32(data))
                out["decoded_equal"].append(fine)
            yield _arrow(out | {"doc_id": batch.column("doc_id")}, SUMS)

    return rows.mapInArrow(run, SUMS)


def chunks_of(rows: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """The marked texts cut into chunks, each with what the longest piece may see on both sides. Written once."""

    def run(batches: Iterator) -> Iterator:
        side = model(path).longest
        for batch in batches:
            for row, doc, text in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = Model.marked(text)
                cuts = range(0, len(s), chunk_chars)
                for at in range(0, len(cuts), 64):  # a batch holds 64 chunks
                    some = [(k, a, min(a + chunk_chars, len(s))) for k, a in enumerate(cuts[at : at + 64], at)]
                    yield _arrow({
                        "_row": [row] * len(some), "doc_id": [doc] * len(some), "k": [k for k, _, _ in some], "n": [len(cuts)] * len(some),
                        "before": [s[max(0, a - 2 * side) : a] for _, a, _ in some], "body": [s[a:b] for _, a, b in some], "after": [s[b : b + 2 * side] for _, _, b in some],
                    }, CHUNK)

    return stored(rows.mapInArrow(run, CHUNK).repartition(F.col("_row"), F.col("k")), "chunks")


def _ends(m: Model, k: int, n: int, before: str, body: str, after: str) -> tuple[str, int, int, list[State], list[State]]:
    """The text of a chunk with its sides, where it starts and ends, and the states there."""
    s = before + body + after
    start, end = len(before), len(before) + len(body)
    ins = m.states(s, start) if k else [(None, 0)]
    outs = m.states(s, end)
    return s, start, end, ins, outs if k < n - 1 else [x for x in outs if x[1] == 0]


MATRIX = "_row long, k int, n_in int, n_out int, m binary"


def matrices(chunks: DataFrame, path: str) -> DataFrame:
    """(_row, k, n_in, n_out, m): each chunk's transfer matrix."""

    def run(batches: Iterator) -> Iterator:
        m = model(path)
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in MATRIX.split(", ")}
            for x in batch.to_pylist():
                s, start, end, ins, outs = _ends(m, x["k"], x["n"], x["before"], x["body"], x["after"])
                t = m.transfer(s, start, end, ins, outs)
                for c, v in (("_row", x["_row"]), ("k", x["k"]), ("n_in", len(ins)), ("n_out", len(outs)), ("m", t.tobytes())):
                    out[c].append(v)
            yield _arrow(out, MATRIX)

    return stored(chunks.select("_row", "k", "n", "before", "body", "after").mapInArrow(run, MATRIX), "matrices")


def _matrices_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, dtype=np.float32).reshape(a, b) for m, a, b in zip(pdf["m"], pdf["n_in"], pdf["n_out"], strict=True)]


def chunk_states(mats: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_row, k, first, last): the state at each chunk's start and end, by products of blocks, then down again."""
    mats = mats.withColumn("b", F.expr(f"k div {block}").cast("int"))

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        m = functools.reduce(product, _matrices_of(pdf.sort_values("k")))
        return pd.DataFrame({"_row": pdf["_row"].iloc[:1], "b": pdf["b"].iloc[:1], "n_in": [m.shape[0]], "n_out": [m.shape[1]], "m": [m.tobytes()]})

    def of_document(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        states = states_between(_matrices_of(pdf), 0, None)
        return pd.DataFrame({"_row": pdf["_row"], "b": pdf["b"], "first": states[:-1], "last": states[1:]})

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        states = states_between(_matrices_of(pdf), int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0]))
        return pd.DataFrame({"_row": pdf["_row"], "k": pdf["k"], "first": states[:-1], "last": states[1:]})

    blocks = mats.groupBy("_row", "b").applyInPandas(combined, "_row long, b int, n_in int, n_out int, m binary")
    ends = blocks.groupBy("_row").applyInPandas(of_document, "_row long, b int, first int, last int")
    return mats.join(ends, ["_row", "b"]).groupBy("_row", "b").applyInPandas(of_block, "_row long, k int, first int, last int")


TRACED = "_row long, doc_id long, k int, chars long, ids binary, decodes boolean"


def traced(chunks: DataFrame, states: DataFrame, path: str) -> DataFrame:
    """(_row, doc_id, k, chars, ids, decodes): the pieces that start in each chunk, traced back by itself."""

    def run(batches: Iterator) -> Iterator:
        m = model(path)
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in TRACED.split(", ")}
            for x in batch.to_pylist():
                s, start, end, ins, outs = _ends(m, x["k"], x["n"], x["before"], x["body"], x["after"])
                piece, over = ins[x["first"]]
                data, fine = m.between(s, start + over, end + outs[x["last"]][1], piece)
                for c, v in (("_row", x["_row"]), ("doc_id", x["doc_id"]), ("k", x["k"]), ("chars", len(x["body"])), ("ids", data), ("decodes", fine)):
                    out[c].append(v)
            yield _arrow(out, TRACED)

    return chunks.join(states, ["_row", "k"]).select("_row", "doc_id", "k", "n", "before", "body", "after", "first", "last").mapInArrow(run, TRACED)


def scanned(docs: DataFrame, path: str, chunk_chars: int, block: int = BLOCK) -> DataFrame:
    """``traced`` of all rows of ``docs`` (_row, doc_id, text), by the scan."""
    chunks = chunks_of(docs, path, chunk_chars)
    return traced(chunks, chunk_states(matrices(chunks, path), block), path)


def encoded(docs: DataFrame, path: str, chunk_chars: int = 32_768, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32 (little-endian uint32 ids) and decoded_equal of every whole text.

    Texts longer than ``chunk_chars`` go through the scan; only their chunks' numbers
    meet in a document, never its text or ids. decoded_equal: the pieces' text is the
    text, with the blank character of the model read as a space. Null texts are empty
    (no piece, the checksum 0); repeated and null ids and repeated rows are ordinary
    rows; an empty table gives no row; other columns are ignored.
    """

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([shifted_crc(int(c), int(n)) for c, n in zip(crc, after, strict=True)], dtype="int64")

    rows = _rows(docs, id_col, text_col)
    small = _whole(rows.where(F.length("text") <= chunk_chars), path)
    giant = rows.where(F.length("text") > chunk_chars).withColumn("_row", F.monotonically_increasing_id())
    parts = scanned(giant, path, chunk_chars, block).select("_row", "doc_id", "k", "chars", F.length("ids").cast("long").alias("size"), F.crc32("ids").alias("crc"), "decodes")
    later = Window.partitionBy("_row").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    placed = parts.withColumn("after", F.coalesce(F.sum("size").over(later), F.lit(0))).withColumn("part", shifted("crc", "after"))
    large = placed.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        (F.sum("chars") - 1).alias("n_chars"),
        F.expr("sum(size) div 4").alias("n_pieces"),
        F.bit_xor("part").alias("ids_crc32"),
        F.every("decodes").alias("decoded_equal"),
    )
    return small.unionByName(large.drop("_row"))


def decoded(pieces: DataFrame, path: str, key: tuple[str, ...] = ("_row", "doc_id", "k"), ids_col: str = "ids") -> DataFrame:
    """``key`` and the text of each row's ids (bytes of uint32; null: empty), blanks visible, so that a document's parts join."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series([m.joined(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in ids])

    return pieces.select(*key, text(ids_col).alias("text"))
