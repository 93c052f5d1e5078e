"""Canonical exact document fingerprints, in DataFrame operations.

A text is brought to one form (compatibility decomposition and case folding of
every character, canonical order of combining marks, white space runs as one
blank, none at the ends) and digested by two chained 64-bit xxHash values.
Where two canonical texts share the 128-bit digest, their bytes are compared,
and different ones get fingerprints of their own.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, tasks, whole_text

#: White space that is folded besides what decomposes to a blank.
_BLANKS = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{1680}\\x{2028}\\x{2029}]+"
#: Up to so many ids (16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HANGUL = (0xAC00, 0xD7A3)


def _fold_char(c: str) -> str:
    """Decomposes and folds one character until it stays as it is."""
    while True:
        new = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold())
        if new == c:
            return c
        c = new


@functools.cache
def _tables() -> tuple[str, str, str, str, str]:
    """Made by rule from Python's Unicode data.

    Characters that fold, their folded forms; combining marks, their classes;
    the marks as a regular expression's class.
    """
    keys, forms, marks, classes, spans = [], [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if k := unicodedata.combining(c):
            marks.append(c)
            classes.append(str(k))
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
        if not _HANGUL[0] <= code <= _HANGUL[1] and (f := _fold_char(c)) != c:
            keys.append(c)
            forms.append(f)
    cls = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)
    return "".join(keys), "\x01".join(forms), "".join(marks), ",".join(classes), cls


def _bmp(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _folded(c: Column) -> Column:
    keys, forms, *_ = _tables()
    at = F.position(c, F.lit(keys))
    s = F.ascii(c) - _HANGUL[0]
    tail = F.when(s % 28 == 0, F.lit("")).otherwise(_bmp((s % 28 + 0x11A7).cast("long")))
    hangul = F.concat(_bmp((F.floor(s / 588) + 0x1100).cast("long")), _bmp((F.floor((s % 588) / 28) + 0x1161).cast("long")), tail)
    return (
        F.when(c.between(chr(_HANGUL[0]), chr(_HANGUL[1])), hangul)
        .when(at > 0, F.element_at(F.split(F.lit(forms), "\x01"), F.greatest(at, F.lit(1))))
        .otherwise(c)
    )


def _in_order(text: Column) -> Column:
    """Sorts each run of combining marks by class, keeping the order of equals."""
    _, _, marks, classes, cls = _tables()
    codes = F.split(F.lit(classes), ",")

    def run(r: Column) -> Column:
        items = F.transform(
            F.split(r, ""),
            lambda c, i: F.struct(F.element_at(codes, F.greatest(F.position(c, F.lit(marks)), F.lit(1))).cast("int").alias("k"), i.alias("i"), c.alias("c")),
        )
        return F.array_join(F.transform(F.array_sort(items), lambda x: x["c"]), "")

    parts = F.regexp_extract_all(text, F.lit(f"([{cls}]+|[^{cls}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{cls}]{{2,}}"), run(p)).otherwise(p)), "")


def with_canonical(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds the canonical form; two texts that differ only in Unicode form, case or white space share it.

    Each step is a column of its own, so that none is evaluated twice.
    """
    text, cls = F.col(text_col), _tables()[-1]
    other = F.array_distinct(F.regexp_extract_all(text, F.lit("([^\\x00-\\x7F])"), F.lit(1)))
    folded = F.aggregate(other, text, lambda acc, c: F.replace(acc, c, _folded(c)))
    df = df.withColumn("_f1", F.when(F.octet_length(text) > F.length(text), folded).otherwise(text))
    # the general category is tested first: it is far cheaper than the class of all marks
    runs = (F.octet_length("_f1") > F.length("_f1")) & F.col("_f1").rlike("\\p{M}{2}") & F.col("_f1").rlike(f"[{cls}]{{2,}}")
    df = df.withColumn("_f2", F.when(runs, _in_order(F.col("_f1"))).otherwise(F.col("_f1")))
    # Only A-Z can be left in upper case here; lower() would treat a final sigma by its place.
    low = F.when(F.octet_length("_f2") > F.length("_f2"), F.translate("_f2", _UPPER, _UPPER.lower())).otherwise(F.lower("_f2"))
    return df.withColumn(name, F.trim(F.regexp_replace(low, _BLANKS, " "))).drop("_f1", "_f2")


def digest(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    halves = (F.xxhash64(canon), F.xxhash64(F.lit("second half"), canon))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def tell_apart(texts: DataFrame, digest_col: str = "digest", canon_col: str = "canon") -> DataFrame | None:
    """Compares the canonical bytes of rows with equal digests.

    Returns (digest, canon, suffix) for the digests that stand for more than one
    canonical text, or None if there are none. The least and greatest text of a
    digest are found by partial aggregation, so a huge group of copies costs one
    row a task; texts are dealt by digest only where there is a real collision.
    """
    spread = texts.groupBy(digest_col).agg(F.min(canon_col).alias("_lo"), F.max(canon_col).alias("_hi"))
    clash = stored(spread.where("_lo < _hi").select(digest_col), "clashes")
    if not clash.limit(1).count():
        return None
    forms = texts.join(clash, digest_col, "left_semi").select(digest_col, canon_col).distinct()
    order = Window.partitionBy(digest_col).orderBy(canon_col)
    return stored(forms.withColumn("suffix", F.concat(F.lit("-"), F.row_number().over(order).cast("string"))), "apart")


def neighbours(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Adds ``next``: the struct of ``columns`` of the row with the next higher id; after the last, the first.

    The ids are cut into ranges at ids that exist (found by a sketch). The row a
    range starts with is dealt to the range before as well, as its last
    neighbour. So each range is sorted by itself, and every text moves once.
    Rows of equal id follow each other by their columns; null ids come first.
    """
    spark = docs.sparkSession
    rank = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    n = 4 * tasks(spark)
    marks = docs.select(rank.alias("k")).agg(
        F.min("k").alias("lo"), F.percentile_approx("k", [i / n for i in range(1, n)], 10_000).alias("cuts")
    ).first()
    if marks["lo"] is None:
        return docs.withColumn("next", F.struct(*columns))
    cuts = sorted({marks["lo"], *marks["cuts"]})
    bounds = F.array(*map(F.lit, cuts))
    # the range's number: the bounds are few (four for each task), and sorted
    own = F.size(F.filter(bounds, lambda b: b <= F.col("_k"))) - 1
    home = (F.col("_own") + len(cuts) - 1) % len(cuts)
    dealt = (
        docs.withColumn("_k", rank)
        .withColumn("_own", own)
        .withColumn("_at", F.explode(F.when(F.array_contains(bounds, F.col("_k")), F.array(
            F.struct(F.col("_own").alias("r"), F.lit(False).alias("guest")),
            F.struct(home.alias("r"), F.lit(True).alias("guest")),
        )).otherwise(F.array(F.struct(F.col("_own").alias("r"), F.lit(False).alias("guest"))))))
        .select("*", F.col("_at.r").alias("_range"), F.col("_at.guest").alias("_guest"))
        .drop("_at", "_own")
    )
    order = Window.partitionBy("_range").orderBy("_guest", "_k", *columns)
    return (
        dealt.withColumn("next", F.lead(F.struct(*columns)).over(order))
        .where(~F.col("_guest"))
        .drop("_k", "_range", "_guest")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    The edited text has the last half (rounded down) of the code points replaced
    by the first as many of the next document. An exact digest's likeness is 1
    for equal fingerprints and 0 for others. Null texts are empty; repeated ids
    and rows are ordinary rows; an empty table gives no row; other columns are
    ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    pairs = neighbours(_digested(base, "text", "digest"), "doc_id", ["text", "digest", "doc_id"])
    first = stored(
        _digested(pairs.withColumn("edited", _edited("text", "next.text")), "edited", "edited_digest").select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "digest",
            "edited_digest",
            F.col("next.digest").alias("next_digest"),
            F.col("next.doc_id").alias("next_id"),
        ),
        "digests",
    )
    every = first.select("digest").unionAll(first.select(F.col("edited_digest").alias("digest")))
    shared = stored(every.groupBy("digest").count().where("count > 1").select("digest"), "shared-digests")
    apart = tell_apart(_texts_of(base, first, shared))
    return _result(first if apart is None else _with_suffixes(base, first, apart))


def _edited(text: str, following: str) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - half), F.substring(F.col(following), F.lit(1), half))


def _digested(df: DataFrame, text_col: str, name: str, canon: str | None = None) -> DataFrame:
    out = with_canonical(df, text_col, canon or "_canon").withColumn(name, digest(F.col(canon or "_canon")))
    return out if canon else out.drop("_canon")


def _texts_of(base: DataFrame, first: DataFrame, shared: DataFrame) -> DataFrame:
    """(digest, canon) of the texts and edited texts whose digest is shared.

    Only those documents, and the ones that follow an edited one, are read again.
    """
    key = lambda c: F.coalesce(c, F.lit(-(2**63)))
    own = first.join(shared, "digest", "left_semi").select(key("doc_id").alias("_k"))
    redo = first.where("digest <> edited_digest").join(shared.withColumnRenamed("digest", "edited_digest"), "edited_digest", "left_semi")
    redo = redo.select(key("doc_id").alias("_k"), key("next_id").alias("_next"))
    wanted = stored(own.unionAll(redo.select("_k")).unionAll(redo.select("_next")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = stored(base.withColumn("_k", key("doc_id")).join(wanted, "_k", "left_semi").select("_k", "text"), "texts")
    edits = redo.join(texts, "_k").join(texts.toDF("_next", "_following"), "_next").select(_edited("text", "_following").alias("text"))
    both = _digested(texts.join(own.distinct(), "_k", "left_semi").select("text").unionAll(edits), "text", "digest", "canon")
    return both.select("digest", "canon")  # no join on the digest here: one of them may have a third of all rows


def _with_suffixes(base: DataFrame, first: DataFrame, apart: DataFrame) -> DataFrame:
    """For digests that stand for several texts: the text's number follows the digest.

    Collisions of 128 bits do not happen by chance, so this reads all texts again.
    """
    full = neighbours(base, "doc_id", ["text"]).withColumn("edited", _edited("text", "next.text")).withColumn("following", F.col("next.text")).drop("next")
    full = full.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited", "following")
    for text, name in (("text", "digest"), ("edited", "edited_digest"), ("following", "next_digest")):
        full = _digested(full, text, "_d", "_c").drop(text)
        part = apart.select(F.col("digest").alias("_pd"), F.col("canon").alias("_pc"), "suffix")
        full = full.join(part, (F.col("_d") == F.col("_pd")) & (F.col("_c") == F.col("_pc")), "left")
        full = full.withColumn(name, F.concat("_d", F.coalesce("suffix", F.lit("")))).drop("_d", "_c", "_pd", "_pc", "suffix")
    return full


def _result(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("digest").alias("fingerprint"),
        F.col("edited_digest").alias("edited_fingerprint"),
        (F.col("digest") == F.col("edited_digest")).cast("double").alias("near_edited"),
        (F.col("digest") == F.col("next_digest")).cast("double").alias("near_next"),
    )
