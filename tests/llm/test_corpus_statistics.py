"""Collocations, token files and the divergence audit against brute-force versions."""

import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import divergence, phrases, token_files

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (None, "en", "a"), ("", "en", "a"), ("x y, x y. x\ny x y!x y", None, None), ("a b a b a b a b", "en", "b"), ("a b a b a b a b", "en", "b"),
    ("É é É é Straße\tSTRASSE  ß", "de", "ü"), ("\x00 \x01a \x0b b\x0cc\rd", "de", ""), ("new york city, new york city; york new", "en", "c"),
    ("w " * 20_000, "en", "long"), ("only dots ... ,,, !!", "fr", "a"), ("123 456", "xx", "z"), ("𝄞 𝄞 ｚ ｚ", "de", "ü"),
]


@pytest.fixture(scope="module")
def rows(spark, sf):
    own = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return own + [(1000 + i, *t) for i, t in enumerate(ODD)] + [(None, "null id", "en", "a"), (1003, "twice", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = ["n", "term", "word", "phrase", "a", "h", "p", "value", "rank", "name", "_h", "_at", "docs", "a.b", "a b", "t`k"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    return df.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def brute_collocations(rows, least, longest, top, share):
    n, f = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    inside = defaultdict(int)
    for (lang, w), a in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(a, inside[lang, w[i : i + m]])
    found = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside[lang, w] < share * a:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize("least,top,share,trie_phrases,listed", [(4, 2000, 100, 10**6, 10**6), (3, 25, 80, 700, 0)])
def test_collocations(docs, rows, least, top, share, trie_phrases, listed, monkeypatch):
    monkeypatch.setattr(phrases, "LISTED", listed)
    got = phrases.collocations(docs, least=least, top=top, share=share, trie_phrases=trie_phrases)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, least, 5, top, share)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_nothing(spark, empty):
    assert phrases.collocations(empty).count() == 0
    few = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    assert phrases.collocations(few).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=5).map(" ".join), min_size=1, max_size=60, unique=True), st.lists(st.sampled_from("abcdefghz,"), max_size=80))
def test_trie_counts_every_phrase(listed, text):
    closed = sorted({" ".join(p.split()[:i]) for p in listed for i in range(1, len(p.split()) + 1)})
    trie = phrases.Trie([("en", p) for p in closed if " " in p])
    if not trie.words:
        return
    own = trie.words["en"]
    sym = np.array([own.get(w.encode(), 0) for w in text] + [0], np.int64)
    total = np.zeros(len(trie.check), np.int64)
    trie.counts(sym, total)
    long = [p for p in closed if " " in p]
    want = {p: sum(text[i : i + len(p.split())] == p.split() for i in range(len(text))) for p in long}
    assert {long[i]: int(total[s]) for s, i in trie.phrase.items()} == want


def test_token_files(spark, docs, rows, tmp_path):
    path = P.path("word_bpe_49k.json")
    about = token_files.write(docs, path, f"file://{tmp_path}/out", rows_each=20)
    library = Tokenizer.from_file(path)
    got = token_files.read(spark, f"file://{tmp_path}/out", rows_each=7).collect()
    assert sorted(r.start for r in got) == [r.start for r in got]
    ids_of = defaultdict(list)
    for doc_id, text, _, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        ids_of[doc_id].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start, found = 0, defaultdict(list)
    for r in got:
        assert r.start == start
        start += r.n_tokens
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in ids_of.items()}
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert about["documents"] == len(rows) and about["ids"] == start and len(about["parts"]) > 1 and about["dtype"] == "<u2"
    files = token_files.TokenFiles(f"{tmp_path}/out")
    assert len(files) == len(rows) and all(zlib.crc32(files.ids(k).astype("<u4")) == got[k].ids_crc32 for k in range(len(files)))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert [n for n in names if n.endswith(".ids")] == [f"{p['name']}.ids" for p in json.loads((tmp_path / "out/parts.json").read_text())["parts"]]
    assert not [n for n in names if n.startswith(".") or n.endswith(".own")]


def test_token_files_of_nothing_and_of_one_id(spark, empty, tmp_path):
    path = P.path("word_bpe_49k.json")
    assert token_files.write(empty, path, f"{tmp_path}/empty")["parts"] == []
    assert token_files.read(spark, f"{tmp_path}/empty").count() == 0
    same = spark.createDataFrame([(7, "one text")] * 400, "doc_id long, text string").repartition(4)
    about = token_files.write(same, path, f"{tmp_path}/same", rows_each=20)
    assert len(about["parts"]) > 4, "one id and one text are dealt to several parts"
    assert token_files.read(spark, f"{tmp_path}/same").select("n_tokens", "ids_crc32").distinct().count() == 1


def brute_audit(rows, least_docs, top):
    groups, docs_of, count = set(), Counter(), Counter()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        docs_of.update((lang, w) for w in set(own))
        count.update((lang, source, w) for w in own)
    kept = {k for k, v in docs_of.items() if v >= least_docs}
    out = []
    for lang in {g[0] for g in groups}:
        terms = [w for x, w in kept if x == lang]
        sources = sorted(s for x, s in groups if x == lang)
        share = {}
        for s in sources:
            total = sum(count[lang, s, w] for w in terms)
            share[s] = {w: 1 + 10**9 * (count[lang, s, w] + 2) // (total + 2 * len(terms)) for w in terms}
        of_lang = {w: sum(count[lang, s, w] for s in sources) for w in terms}
        q = {w: 1 + 10**9 * (of_lang[w] + 2) // (sum(of_lang.values()) + 2 * len(terms)) for w in terms}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(f(share[s][w], share[o][w]) for w in terms), o.encode()) for o in sources if o != s)
            marks = sorted((-f(share[s][w], q[w]), w.encode()) for w in terms if count[lang, s, w] and share[s][w] > q[w])[:top]
            for part, own in (("pair", pairs), ("term", marks)):
                out += [(lang, s, part, name.decode(), -v, i) for i, (v, name) in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize("least_docs,top", [(10, 10), (1, 3)])
def test_audit(docs, rows, least_docs, top):
    got = divergence.audit(docs, least_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute_audit(rows, least_docs, top)
    assert {r[2] for r in want} == {"pair", "term"} and sorted(map(tuple, got.collect())) == want


def test_audit_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0
    few = spark.createDataFrame([(1, None, None, "s"), (2, "a", None, None)], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(few).collect())) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=60), st.integers(1, 5), st.randoms())
def test_skyband_is_exact(counts, k, random):
    names = [f"t{i:02d}".encode() for i in range(len(counts))]
    random.shuffle(names)
    g, c = (np.array(x, np.int64) for x in zip(*counts, strict=True))
    got = set(divergence.skyband(g, c, np.array(names, dtype=object), k).tolist())
    over = lambda j, i: g[j] >= g[i] and c[j] <= c[i] and names[j] < names[i]
    assert got == {i for i in range(len(counts)) if sum(over(j, i) for j in range(len(counts))) < k}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**15), st.integers(0, 8 * 10**15), st.integers(1, 10**14))
def test_shares_are_exact(count, total, kept):
    count = min(count, total)
    assert int(divergence.shares(np.array([count]), total, kept)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * kept)
