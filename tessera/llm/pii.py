"""Personal data by fixed rules and bootstrapped contextual extraction, in DataFrame operations.

The rules' findings are seeds. The two words before a seed are a lexical pattern
for its kind. Patterns and the identifier-like tokens they precede form a graph
that is scored in rounds, until a round finds nothing new: a pattern by the share of
its slots, in all documents, that hold known identifiers; a token by the patterns that
precede it. Tokens over the threshold become known, bring in their other contexts, and
are reported besides the rules' findings wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import quoted, stored, whole_text

#: The kinds in their order, and their patterns. Possessive repeats
#: and look-behinds only save backtracking; they match what the plain forms match.
KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_CUE = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: The characters of words in lexical patterns, and an identifier-like word.
_WORD = r"[^\s=:\"'<>(),;]"
_TOKEN = rf"(?<!{_WORD})(?={_WORD}*[0-9@]){_WORD}++"
CONTEXT_CHARS = (64, 1024)
ITEMS = "array<struct<start:int,kind:int,end:int,context:string,surface:string>>"
#: The part of the documents whose slots are counted first.
_ONE_IN = 16
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Characters, and hits, that are handled in one block, so that long texts take linear time.
BLOCK_CHARS, BLOCK_HITS = 1024, 256
#: Stands for the characters of base spans while tokens are sought; a token with it is none.
_TAKEN = "\ue000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, as the variable of a function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    d = F.reverse(_digits(hit))

    def step(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(False)


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def found(text: Column, pattern: str, kind: int, passes, cue: str) -> Column:
    """The spans (start, kind, end in code points) of a pattern's hits that pass.

    The lengths of the texts between hits and of the hits give the positions: summed
    inside blocks of hits, then over the blocks.
    """
    items = "array<struct<start:int,end:int,h:string>>"

    def in_block(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(items).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["h"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("h")))).alias("out"))

        return F.aggregate(p, zero, step)

    def placed(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("h")))
        return _let(pairs, lambda p: _let(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(BLOCK_HITS)), lambda i: in_block(F.slice(p, i, F.lit(BLOCK_HITS)))), over_blocks))

    def over_blocks(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, at: F.transform(F.filter(b["out"], lambda x: passes(x["h"])), lambda x: F.struct((x["start"] + at).alias("start"), F.lit(kind).alias("kind"), (x["end"] + at).alias("end"))))
        return F.flatten(moved)

    hits = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(cue), _let(hits, placed)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def blocks_of(text: Column) -> Column:
    """The text in blocks of characters, from which ``piece`` reads without passing all that stands before."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(BLOCK_CHARS)), lambda i: F.substring(text, i + 1, F.lit(BLOCK_CHARS)))


def piece(blocks: Column, start: Column, n: Column) -> Column:
    first, last = F.floor(start / BLOCK_CHARS).cast("int"), F.floor((start + n) / BLOCK_CHARS).cast("int")
    held = F.when(first == last, F.coalesce(F.get(blocks, first), F.lit(""))).otherwise(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
    return F.substring(held, start - first * BLOCK_CHARS + 1, n)


def base_spans(text: Column) -> Column:
    """All findings of the rules, by start, then kind."""
    each = [found(text, PATTERNS[k], i, lambda h, k=k: _passes(k, h), _CUE[k]) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(blocks: Column, start: Column) -> Column:
    """The two words before a position, whole and lower-cased; fewer at the start of a text.

    They are read from the characters before it; a first word that may be cut does not count,
    and where fewer than two are left, more characters are read.
    """

    def last_two(words: Column) -> Column:
        return F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ")

    def within(chars: int, more: Column) -> Column:
        window = F.lower(piece(blocks, F.greatest(start - chars, F.lit(0)), F.least(start, F.lit(chars))))
        return _let(_words(window), lambda w: F.when((start <= chars) | (F.size(w) > 2), last_two(w)).otherwise(more))

    known = _let(_words(F.lower(piece(blocks, F.lit(0), start))), last_two)
    for chars in reversed(CONTEXT_CHARS):
        known = within(chars, known)
    return known


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_WORD}+"), F.lit(0))


def scanned(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Every row's base spans, and the contexts and surfaces of seeds and of identifier-like tokens outside them.

    The kept columns are in one, ``row``, so that their names meet no others.
    """
    text, base = F.col("_text"), F.col("_base")
    kept = F.struct(*map(quoted, keep)) if keep else F.struct(F.lit(None).alias("none"))
    rows = docs.select(kept.alias("row"), F.col(id_col).cast("long").alias("_doc"), whole_text(text_col).alias("_text")).withColumn("_base", base_spans(text))
    hidden = lambda _, n: F.repeat(F.lit(_TAKEN), n)
    rest = _filled(text, base, hidden, hidden)
    free = found(rest, _TOKEN, -1, lambda h: (F.length(h) >= 5) & ~h.contains(_TAKEN), "[0-9@]")

    def described(blocks: Column, s: Column) -> Column:
        surface = F.lower(piece(blocks, s["start"], s["end"] - s["start"]))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _context(blocks, s["start"]).alias("context"), surface.alias("surface"))

    items = _let(blocks_of(text), lambda b: F.transform(F.col("_spots"), lambda s: described(b, s)))
    return (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_spots", F.concat(base, free))
        .withColumn("_items", F.when(F.size("_spots") > 0, items).otherwise(F.array().cast(ITEMS)))
        .drop("_spots")
    )


def _slots(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """How often each pattern's words stand in all documents (context, slots); one word only counts at the start of a text.

    A table of 65,536 bits, made from the patterns' hashes, drops most word pairs
    before they are counted; the join decides.
    """
    bits = 1 << 16
    parts = F.split("context", " ", 2)
    pair = F.xxhash64(F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit("")))
    marks = [r[0] for r in patterns.select(F.pmod(pair, F.lit(bits)).alias("b")).distinct().collect()]
    words64 = [0] * (bits // 64)
    for m in marks:
        words64[m // 64] |= 1 << m % 64
    table = F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words64])

    def marked(*words: Column) -> Column:
        h = F.pmod(F.xxhash64(*words), F.lit(bits))
        return F.getbit(F.element_at(table, (F.shiftright(h, 6) + 1).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1

    def standing(words: Column) -> Column:
        places = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        pairs = F.filter(places, lambda i: marked(F.element_at(words, i), F.element_at(words, i + 1)))
        first = F.filter(F.slice(words, F.lit(1), F.lit(1)), lambda w: marked(w, F.lit("")))
        return F.concat(first, F.transform(pairs, lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))

    # the words of a text are found once, as the variable of a function
    kept = _let(_words(F.lower(whole_text(text_col))), standing)
    counted = docs.select(F.explode(kept).alias("context")).groupBy("context").agg(F.count(F.lit(1)).alias("slots"))
    return patterns.select("context").distinct().join(counted, "context", "left").select("context", F.coalesce("slots", F.lit(0)).alias("slots"))


def bootstrap(items: DataFrame, docs: DataFrame, text_col: str, support: int, confidence: float) -> DataFrame:
    """(surface, kind) of the tokens that the patterns reveal, by rounds over the pattern-instance graph.

    What is known only grows from round to round, and so do the scores; a round that
    reveals no more tokens than the one before ends it.

    A pattern precedes at least ``support`` known identifiers of its kind, at every size.
    The slots of some of the documents bound the slots of all from below: patterns that
    these already make untrue are not counted further. What is left stands at about
    ``_ONE_IN`` times as many places as the identifiers it precedes, so counting is linear.
    """
    graph = stored(items.where("context <> ''").groupBy("context", "surface", "kind").agg(F.count(F.lit(1)).alias("n")), "graph")
    seeds = graph.where("kind >= 0").select("surface", "kind").distinct().withColumn("score", F.lit(1.0))
    known, new, slots, n_new = seeds, seeds.limit(0), None, 0
    while True:
        edges = graph.drop("kind").join(known, "surface")
        patterns = edges.groupBy("context", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("good"), F.countDistinct("surface").alias("s"))
        patterns = stored(patterns.where(F.col("s") >= support).select("context", "kind", "good"), "patterns")
        fresh = patterns if slots is None else patterns.join(slots, "context", "left_anti")
        if fresh.limit(1).count():
            # one that is left out here is tried again in the next round, when more may be known
            most = fresh.groupBy("context").agg(F.max("good").alias("good"))
            some = docs.where(F.pmod(F.xxhash64(whole_text(text_col)), F.lit(_ONE_IN)) == 0)
            fresh = stored(most.join(_slots(some, text_col, fresh), "context").where(F.col("good") >= confidence * F.col("slots") - 1e-9).select("context"), "fresh")
            counted = stored(_slots(docs, text_col, fresh), "slots")
            slots = counted if slots is None else slots.unionAll(counted)
        if slots is None:
            break
        # a pattern that stands nowhere as whole words (an identifier in the midst of a word) has no trust
        trust = patterns.join(slots.where("slots > 0"), "context").withColumn("trust", F.least(F.col("good") / F.greatest("slots", "good"), F.lit(1.0))).where(F.col("trust") >= confidence)
        reach = graph.where("kind < 0").drop("kind").join(trust.select("context", "kind", "trust"), "context")
        scored = reach.groupBy("surface", "kind").agg((1 - F.product(1 - F.col("trust"))).alias("score")).where(F.col("score") >= confidence)
        new = stored(scored.groupBy("surface").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score")), "revealed")
        if (n := new.count()) == n_new:
            break
        known, n_new = seeds.unionByName(new), n
    return new.select("surface", F.col("kind").alias("new_kind"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """Every row of ``docs`` with its base spans and all spans.

    Null texts are empty and have no span. Rows are told apart by a number of
    their own, so repeated or null ids and repeated rows stay single. An empty
    table gives no row. The columns in ``keep`` are the fields of one, ``row``, so
    they may have any names; other columns are dropped. Spans of the method do not
    overlap base spans.

    Returns row and _text (if columns are kept), _doc, _base, _spans.
    """
    own = ["row", "_text"] if keep is not None else []
    rows = stored(scanned(docs, id_col, text_col, keep or []).select(*own, "_doc", "_row", "_base", "_items"), "scanned")
    items = rows.where(F.size("_items") > 0).select("_row", F.explode("_items").alias("i")).select("_row", "i.*")
    revealed = bootstrap(items, docs, text_col, support, confidence)
    added = (
        items.where("kind < 0")
        .join(revealed, "surface")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", F.col("new_kind").alias("kind"), "end")).alias("_added"))
    )
    spans = F.array_sort(F.concat("_base", F.coalesce(F.col("_added"), F.array().cast(SPAN))))
    return rows.join(added, "_row", "left").select(*own, "_doc", "_base", spans.alias("_spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; see ``extract``."""
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size("_base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return extract(docs, id_col, text_col, **how).select(
        F.col("_doc").alias("doc_id"),
        *counts,
        F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_added"),
    )


def _filled(text: Column, spans: Column, first: Callable[[Column, Column], Column], more: Callable[[Column, Column], Column]) -> Column:
    """The text with each run of overlapping spans replaced: by ``first`` of kind and length, and what later ones add by ``more``."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def fold(blocks: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = F.concat(acc["out"], piece(blocks, acc["at"], s["start"] - acc["at"]), first(s["kind"], s["end"] - s["start"]))
            added = F.concat(acc["out"], more(s["kind"], F.greatest(s["end"] - acc["at"], F.lit(0))))
            return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(added).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(_let(blocks_of(text), fold))


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``[KIND]`` of its first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return _filled(text, spans, lambda kind, _: F.element_at(names, kind + 1), lambda *_: F.lit(""))
