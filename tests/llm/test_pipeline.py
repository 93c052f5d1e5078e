"""The pipeline's stages against brute force on a small table."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import pii, simhash


def shingles(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, stages):
    first = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert all(s.schema == first.schema for s in stages[:3])
    kept = {r.doc_id: r.text for r in stages[0].collect()}
    deduped = {r.doc_id: r.text for r in stages[1].collect()}
    masked = {r.doc_id: r.text for r in stages[2].collect()}
    assert set(deduped) <= set(kept) and set(masked) == set(deduped)
    assert len(set(deduped.values())) == len(deduped)
    sets = {d: shingles(t) for d, t in kept.items()}
    near = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    assert sum(a in deduped and b in deduped for a, b in near) <= 0.02 * len(near)
    # a document goes only for one that is like it
    close = defaultdict(set)
    for a in kept:
        for b in kept:
            if a != b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]):
                close[a].add(b)
    assert all(close[d] for d in set(kept) - set(deduped))
    assert not any("@mail" in t for t in masked.values()) and any("[EMAIL]" in t for t in masked.values())
    assert {r.doc_id for r in stages[3].collect()} == set(masked)


def test_one_of_each_classes(spark):
    """Pairing only between the classes that leaders found keeps the same rows as pairing all."""
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(8):
        base = rng.choice(vocab, 200).tolist()
        for _ in range(12):
            own = list(base)
            for at in rng.integers(0, 200, rng.integers(0, 4)):
                own[at] = "zz" + str(rng.integers(0, 99))
            texts.append(" ".join(own))
    rows = [*enumerate(texts), (500, None), (501, ""), (None, texts[0]), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pid", __import__("pyspark").sql.functions.lit(1))
    plain = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    for rounds in (0, 1):
        assert plain == sorted(r.doc_id for r in simhash.one_of_each(df, rounds=rounds).collect())
    assert len(plain) <= 8 + 4 and plain[0] == 0
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_links_near_fingerprints_by_the_grid(spark, monkeypatch):
    """Without the exact search, texts within two bits that are alike are still linked, and none that are not."""
    rng = np.random.default_rng(4)
    base = [[f"g{g}w{i}" for i in range(400)] for g in range(30)]
    texts = [" ".join(w) for w in base] + [" ".join([*w, *(f"e{rng.integers(10**9)}" for _ in range(k % 3))]) for k, w in enumerate(base)]
    texts += ["".join(f"{t.upper()} ") for t in texts[:5]]
    prints = simhash.signatures(texts, 5)[:, 0]
    sets = [shingles(t) for t in texts]
    near = {(a, b) for a in range(len(texts)) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= 2}
    alike = {(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(alike) >= 15
    chosen = simhash._chosen_cells
    monkeypatch.setattr(simhash, "_chosen_cells", lambda points: chosen(points).limit(0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert got == set(range(len(texts))) - {a for a, _ in alike}


def test_groups_grow_with_the_points():
    """A cell's key keeps about as many bits as the points need."""
    assert simhash.groups_for(1) == 5 and simhash.groups_for(10**6) == 5
    for n in (10**9, 10**10, 10**11):
        g = simhash.groups_for(n)
        assert 48 * (g - 2) / g >= np.log2(n) + 1 and g <= 16


def test_masking_keeps_null_and_plain_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "no data", 7), (3, "to a@b.cd now", 13)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, df, "").collect()}
    assert got == {1: (None, 0), 2: ("no data", 7), 3: ("to [EMAIL] now", 14)}
    assert pii.KINDS[0] == "email"


def test_one_of_each_is_exact_at_the_limit(spark):
    """All pairs at 0.80 and above are linked and none below, short and long texts, and texts that repeat a run."""
    rng = np.random.default_rng(5)
    texts = []
    for g in range(150):
        size = int(rng.integers(8, 250))
        base = [f"g{g}w{i}" for i in range(size)]
        for _ in range(2):
            own = list(base)
            # a changed end changes one shingle for each word: similarities lie about 0.8
            cut = max(1, round((size - 4) * rng.uniform(0.09, 0.13)))
            own[-cut:] = [f"x{rng.integers(10**9)}" for _ in range(cut)]
            texts.append(" ".join(own))
    texts += ["again " * 300 + " ".join(f"r{k}v{i}" for i in range(40)) for k in range(2)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    alike = [5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in zip(range(0, 300, 2), range(1, 300, 2), strict=True)]
    assert 30 < sum(alike) < 120
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert got == {top(x) for x in range(len(texts))}


def test_one_of_each_keeps_columns_of_any_name(spark, tmp_path):
    names = ["_id", "_key", "_text_hash", "pid", "k", "h", "id", "row", "w", "m", "prefix", "cell", "_doc", "_text", "n_words", "text_was_null", "_spans", "_base", "a.b", "a b", "t`k", "a,b", "row.text", "ünï"]
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate([text, text, text + " more", "other " * 60, None])], "doc_id long, text string, n_chars int")
    df = df.selectExpr("*", *[f"'{n}' AS `{n.replace('`', '``')}`" for n in names])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    from tessera.llm import quality

    kept = quality.kept_documents(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2}
    single = simhash.one_of_each(df)
    assert single.columns == df.columns and sorted(r.doc_id for r in single.collect()) == [0, 3, 4]
    masked = corpus_pipeline.personal_data(spark, df, "")
    assert masked.columns == df.columns and masked.count() == 5
    assert {r[n] for r in single.collect() for n in names} == set(names)
    for i, stage in enumerate((kept, single, masked)):
        stage.write.parquet(f"{tmp_path}/{i}")
        assert spark.read.parquet(f"{tmp_path}/{i}").columns == df.columns


def test_components(spark):
    from tessera.llm.components import components

    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1400)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, None), (7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
