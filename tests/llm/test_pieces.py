"""The max-plus scan against the library: pairs that fit, matrices, chunks of any size."""

import functools
import random

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import pieces

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    letters = "abcdeinrst ▁0123.,-=/_ＡÄß数据漢字🎉"
    words = [p.replace("▁", "") for p in pieces.model(PATH).ids]
    made = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 30, 120]))) for _ in range(150)]
    made += ["".join(rng.choice(words) for _ in range(rng.choice([2, 40]))) for _ in range(150)]
    return [*made, "a" * 300, "=" * 333, " " * 77, "aaaaab" * 50, "internationalization" * 20, "", "x", "the quick brown foxes jumped"]


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def by_scan(m, text, chunk, block):
    """The operator's steps without Spark."""
    s, side = m.marked(text), 2 * m.longest
    n = -(-len(s) // chunk)
    ends = [pieces._ends(m, k, n, s[max(0, k * chunk - side) : k * chunk], s[k * chunk : (k + 1) * chunk], s[(k + 1) * chunk : (k + 1) * chunk + side]) for k in range(n)]
    mats = [m.transfer(*e) for e in ends]
    blocks = [functools.reduce(pieces.product, mats[i : i + block]) for i in range(0, n, block)]
    outer, states = pieces.states_between(blocks, 0, None), [0]
    for i in range(len(blocks)):
        states += pieces.states_between(mats[i * block : (i + 1) * block], outer[i], outer[i + 1])[1:]
    assert states == pieces.states_between(mats, 0, None)
    whole = functools.reduce(pieces.product, mats)
    assert (whole == 0).sum() == 1, "one path has weight 0"
    out = b""
    for k, (t, a, b, ins, outs) in enumerate(ends):
        piece, over = ins[states[k]]
        data, same = m.between(t, a + over, b + outs[states[k + 1]][1], piece)
        assert same
        out += data
    return out


def test_paths_of_fitting_pieces_are_the_librarys(texts):
    m = pieces.model(PATH)
    for text in texts:
        s = m.marked(text)
        assert ids(m.between(s, 0, len(s), None)[0]) == m.library.encode(text)
        assert ids(np.array(m.ids_of(m.trace(s, 0, len(s), None)), dtype="<u4").tobytes()) == m.library.encode(text)


def test_scan_over_any_chunks(texts):
    m = pieces.model(PATH)
    for text in texts:
        for chunk in (1, 3, 16, 50) if text else ():
            assert ids(by_scan(m, text, chunk, 3)) == m.library.encode(text)


def test_scan_without_pinches(texts, monkeypatch):
    """A model whose pieces may cross any place takes the same steps with full matrices."""
    m = pieces.model(PATH)
    monkeypatch.setattr(m, "pinched", False)
    for text in texts[::5]:
        for chunk in (7, 40) if text else ():
            assert ids(by_scan(m, text, chunk, 2)) == m.library.encode(text)


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((5, 5)) < 0.4, 0, pieces.LOW).astype(np.float32) for _ in range(3))
    assert np.array_equal(pieces.product(pieces.product(a, b), c), pieces.product(a, pieces.product(b, c)))


def test_checksums_of_parts():
    import zlib

    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.bytes(int(rng.integers(0, 500))), rng.bytes(int(rng.integers(0, 500)))
        assert pieces.shifted_crc(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_spark_scan_and_decoding(spark, texts):
    rows = [(i % 50, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, _row long, text string")
    done = pieces.scanned(df, PATH, 11, 4)
    back = pieces.decoded(done, PATH)
    m = pieces.model(PATH)
    got, text = {}, {}
    for r in done.orderBy("k").collect():
        got[r._row] = got.get(r._row, b"") + bytes(r.ids)
    for r in back.orderBy("k").collect():
        text[r._row] = text.get(r._row, "") + r.text
    for _, i, t in rows:
        assert ids(got.get(i, b"")) == m.library.encode(t)
        assert text.get(i, "") == m.marked(t)
    sums = {(r.n_chars, r.n_pieces, r.ids_crc32, r.decoded_equal) for r in pieces.encoded(df, PATH).collect()}
    assert sums == {(r.n_chars, r.n_pieces, r.ids_crc32, r.decoded_equal) for r in pieces.encoded(df, PATH, chunk_chars=9, block=3).collect()}


def test_exact_ids(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(None, "a b"), (big, "a b"), (big, "long " * 40)], "doc_id long, text string")
    for chunk in (1000, 20):
        got = [r.doc_id for r in pieces.encoded(df, PATH, chunk_chars=chunk).collect()]
        assert sorted(got, key=str) == sorted([None, big, big], key=str)
