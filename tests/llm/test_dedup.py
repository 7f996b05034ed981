"""Near and exact duplicates against all pairs."""

import hashlib
import random

import numpy as np
import pytest
from helpers import Sets, cut_texts, near_documents
from pyspark.sql import functions as F

from remitlens.llm import lattice_dedup, lsh_forest, suffix_dedup
from remitlens.llm.common import table
from remitlens.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, component_id int, n_bytes int, g int"


def test_connected_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    edges += [(2000, 2001 + k) for k in range(200)] + [(7, 7), (None, 3)]
    groups = Sets()
    for a, b in edges:
        if a is not None and a != b:
            groups.join(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: groups.find(x) for x in groups.parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_merge_with_known_prefixes():
    draw = random.Random(2)
    for _ in range(200):
        runs = [
            sorted({bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 30))) + b"\xff" for _ in range(draw.randint(0, 9))})
            for _ in range(draw.randint(0, 9))
        ]
        got = list(suffix_dedup.merged([suffix_dedup.front_coded(r) for r in runs]))
        assert [(e, r, i) for e, _, r, i in got] == sorted((e, r, i) for r, run in enumerate(runs) for i, e in enumerate(run))
        for (before, *_), (entry, shared, *_) in zip([(b"",), *got], got):
            assert shared == suffix_dedup.common_prefix(before, entry)


def cut(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in suffix_dedup.cut_documents(df, **options).collect()}


@pytest.mark.parametrize("hot", [64, 2])
def test_suffix_cuts_of_small_texts(spark, hot):
    draw = random.Random(hot)
    stock = ["".join(draw.choice("abcdé ") for _ in range(300)) for _ in range(3)]

    def piece():
        start = draw.randint(0, 250)
        return draw.choice(stock)[start : start + draw.randint(5, 120)]

    docs = [(i, "".join(piece() for _ in range(draw.randint(0, 6)))) for i in range(60)]
    docs += [(None, stock[0]), (100, None), (101, ""), (102, "a" * 333), (103, "ab" * 200), (104, stock[1]), (105, stock[1])]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS)
    assert cut(df, length=30, k=12, group_bytes=3000, hot=hot) == cut_texts(docs, 30)


def test_hot_windows_that_differ_in_one_byte(spark):
    """Windows equal but for the last byte that their start must share are no repeats."""
    draw = random.Random(6)

    def some(n):
        return "".join(draw.choice("abcdefghij") for _ in range(n))

    docs = []
    for _ in range(60):
        before, after = some(11), some(18)
        docs += [(len(docs) + j, some(40) + before + c + after + some(40)) for j, c in enumerate("xy")]
    docs += [(len(docs), docs[0][1])]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS)
    assert cut(df, length=30, k=12, group_bytes=1500, hot=2) == cut_texts(docs, 30)


def test_suffix_cuts_of_odd_tables(spark):
    assert suffix_dedup.cut_documents(spark.createDataFrame([], DOCS)).count() == 0
    same = spark.createDataFrame([(1, "x" * 150, 0, 0, 0)] * 3, DOCS)
    # the first keeps its first byte, the others nothing
    assert sorted(r.n_removed for r in suffix_dedup.cut_documents(same).collect()) == [149, 150, 150]
    text = suffix_dedup.cut_documents(
        spark.createDataFrame([(1, "é" * 80, 0, 0, 0), (2, "x" + "é" * 60 + "y", 7, 0, 0)], DOCS), carry=("component_id",), as_text=True
    ).collect()
    assert {r.doc_id: (r.kept, r.carried.component_id) for r in text}[2] == ("xy", 7)


def test_registered_suffix_cuts(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in cut_texts(docs, 100).items()}
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op2_suffix_dedup(spark, SF).collect()} == want
    assert sum(w[1] for w in want.values()) > 0


def near(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(df, **options).collect()}


def copies(draw, words, n, edits):
    for _ in range(n):
        own = list(words)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(len(own))] = f"w{draw.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("most", [2048, 25])
def test_near_documents(spark, most):
    draw = random.Random(most)
    texts = []
    for n in (1, 2, 3, 60, 8):
        words = [f"v{draw.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(words), *copies(draw, words, n, 7)]
    texts += [None, "", " \n\t", "One two", "one TWO", "one two three", "É é", "é é"] + texts[:3]
    draw.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS)
    got, want = near(df, size=3, percent=85, most=most), near_documents(docs, 3, 85)
    if most == 2048:
        assert got == want
    else:  # regions deepen: the forest may miss links here, but invents none
        assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
        assert all(want[g[1]][1] == want[i][1] for i, g in got.items())
        assert sum(g[1] == want[i][1] for i, g in got.items()) >= 0.9 * len(got)


def signed_alike(monkeypatch, signed):
    """Every signature is ``signed``, a column over doc_id."""
    own = lsh_forest.features
    monkeypatch.setattr(lsh_forest, "features", lambda *a: own(*a).withColumn("signed", F.when(F.col("signed").isNotNull(), signed)))


def pairs_in_a_template(draw, n):
    """Pairs of near copies, all in one template that links none of the pairs with another."""
    template, docs = [f"t{k}" for k in range(80)], []
    for p in range(n):
        words = template[:40] + [f"p{p}_{k}" for k in range(20)] + template[40:]
        docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join([*words, f"x{p}"]))]
    docs = list(zip(draw.sample(range(1000), len(docs)), (t for _, t in docs)))
    return docs + [(1000 + k, " ".join([*template, f"y{k}"])) for k in range(30)]


def test_near_documents_of_one_last_region(spark, monkeypatch):
    """Links between classes of different blocks of a region that no depth divides."""
    docs = pairs_in_a_template(random.Random(11), 40)
    signed_alike(monkeypatch, F.lit(bytearray(lsh_forest.TREES * lsh_forest.DEPTH * 4)))
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS)
    assert near(df, size=3, percent=85, most=8) == near_documents(docs, 3, 85)


def test_near_documents_that_part_when_a_region_deepens(spark, monkeypatch):
    """All share the first depth's values, and each is alone at the next depth."""
    docs = pairs_in_a_template(random.Random(12), 40)
    at, own = 4 * lsh_forest.DEPTHS[0], 4 * (lsh_forest.DEPTH - lsh_forest.DEPTHS[0])
    trees = [
        F.concat(F.lit(bytearray(at)), F.substring(F.unhex(F.sha2(F.concat("doc_id", F.lit(f"/{t}")), 512)), 1, own))
        for t in range(lsh_forest.TREES)
    ]
    signed_alike(monkeypatch, F.concat(*trees))
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS)
    assert near(df, size=3, percent=85, most=8) == near_documents(docs, 3, 85)


def test_signatures_of_long_texts_tell_strangers_apart():
    draw = np.random.default_rng(4)
    x, y = (np.sort(draw.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2)) for _ in range(2))
    times, plus = lsh_forest._permutations()
    assert (lsh_forest.signatures(x, times, plus) == lsh_forest.signatures(y, times, plus)).sum() == 0


def test_near_documents_of_odd_tables(spark):
    assert lsh_forest.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    same = spark.createDataFrame([(1, "a b c d", 0, 0, 0)] * 2 + [(None, "a b c d", 0, 0, 0), (3, None, 0, 0, 0)], DOCS)
    got = lsh_forest.near_duplicates(same, size=3).collect()
    assert len(got) == 4 and {(r.component_id, r.kept) for r in got if r.doc_id == 1} == {(1, True)}


def test_registered_near_documents(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.op7_lsh_forest(spark, SF).collect()}
    assert got == near_documents(docs, 3, 85)


def near_vectors(rows, least=0.93):
    """vec_id -> (links, class) from all pairs."""
    groups, links, by = Sets(), dict.fromkeys((r[0] for r in rows), 0), {}
    for i, v, label in rows:
        groups.find(i)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by.setdefault((label, len(v)), []).append((i, np.array(v, np.float32).astype(float)))
    for members in by.values():
        x = np.stack([v for _, v in members])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            i, j = members[a][0], members[b][0]
            links[i] += 1
            links[j] += 1
            groups.join(i, j)
    return {i: (links[i], groups.find(i)) for i, _, _ in rows}


@pytest.mark.parametrize("most", [4096, 5])
def test_near_vectors(spark, most):
    draw, rows = np.random.default_rng(5), []
    for c in range(20):
        base = draw.normal(size=16)
        for j in range(10):
            v = (base + draw.normal(size=16) * 0.2 * draw.random()).astype(np.float32).tolist()
            rows += [(len(rows), v, c % 3)] + [(len(rows) + 1, v, c % 3)] * (j % 4 == 0)
    nan, inf = float("nan"), float("inf")
    rows += [
        (1000, None, 1), (1001, [0.0] * 16, 1), (1002, [nan] * 16, 1), (1003, [None] * 16, 1), (1004, [1.0] * 16, None),
        (1005, [1.0, 2.0], 1), (1006, [1.0, 2.25], 1), (1007, [], 1), (1008, [inf] * 16, 1), (1009, [1.0] * 16, None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice_dedup.near_vectors(df, most=most).collect()}
    want = near_vectors(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values()) > 0
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    assert lattice_dedup.near_vectors(df.limit(0)).count() == 0


def test_lattice_recall_at_the_threshold():
    draw = np.random.default_rng(9)
    x, y = draw.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for t in range(lattice_dedup.tables_for(64, 0.93, lattice_dedup.SCALE, lattice_dedup.PROBES)):
        a, b = (lattice_dedup.cells(v, t, lattice_dedup.SCALE, lattice_dedup.PROBES) for v in (x, y))
        met |= (a == b[:, :1]).all(axis=2).any(axis=1) | (b == a[:, :1]).all(axis=2).any(axis=1)
    assert met.mean() >= 0.98


def test_decoding_finds_the_nearest_point():
    z = np.random.default_rng(3).normal(size=(500, 8)) * 2
    home = lattice_dedup.decode(z)
    d = ((z - home) ** 2).sum(axis=1)
    for v in lattice_dedup.NEIGHBOURS:
        assert (((z - home - v) ** 2).sum(axis=1) >= d - 1e-9).all()


def test_registered_vectors(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice_dedup.op1_lattice_dedup(spark, SF).collect()}
    assert got == near_vectors(rows)
