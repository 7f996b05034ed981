"""The pipeline against plain code, stage by stage."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import WORDS, cut_texts, near_documents, own_figures

import __spark_entry__ as entry
import corpus_pipeline as cp
from remitlens.llm import bpe_tree, source_mix
from remitlens.llm.common import table
from remitlens.llm.ranks import encoder
from remitlens.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, the input first."""
    docs, out = table(spark, SF, "documents"), []
    out.append(docs.collect())
    for name, stage in cp.STAGES:
        docs = cut_lineage(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_stages_and_columns(stages):
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "suffix_dedup", "source_mix", "bpe"]
    assert public_tokenizers.path("") and cp.ORACLE_SQL is None
    for rows in stages[1:5]:
        assert rows[0].__fields__ == stages[0][0].__fields__


def test_quality_stage(stages):
    failed = {}
    for r in stages[0]:
        n, _, _, _, again = own_figures(r.text)
        failed[r.doc_id] = n < 10 or 100 * again > 20 * n
    # no host of this table fails in most of its documents
    assert {r.doc_id for r in stages[1]} == {i for i, bad in failed.items() if not bad}


def test_near_duplicate_stage(stages):
    classes = near_documents([(r.doc_id, r.text) for r in stages[1]], 5, 80)
    assert {r.doc_id for r in stages[2]} == {i for i, (_, c) in classes.items() if i == c}


def test_suffix_stage(stages):
    cut = cut_texts([(r.doc_id, r.text) for r in stages[2]], 100)
    want = {i: c[3].decode("utf-8", "ignore") for i, c in cut.items()}
    want = {i: t for i, t in want.items() if not cut[i][1] or WORDS.search(t)}
    assert {r.doc_id: r.text for r in stages[3]} == want
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_mix_stage(stages):
    before, after = {r.doc_id: r for r in stages[3]}, Counter(r.doc_id for r in stages[4])
    assert all(r == before[r.doc_id] for r in stages[4]) and max(after.values()) <= 3
    size = {i: len(WORDS.findall(r.text)) for i, r in before.items()}
    words, taken, longest = Counter(), Counter(), defaultdict(int)
    for i, r in before.items():
        words[r.source] += size[i]
        taken[r.source] += size[i] * after[i]
        longest[r.source] = max(longest[r.source], size[i])
    assert sum(taken.values()) == pytest.approx(sum(words.values()), rel=0.1)
    assert all(taken[s] <= 3 * words[s] for s in words)


def test_token_stage(stages):
    enc = encoder(bpe_tree.VOCABULARY)
    texts = {r.doc_id: r.text for r in stages[3]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for r in stages[5]:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.exact.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_of_odd_tables(spark):
    kind = table(spark, SF, "documents").schema
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(1, good, "en", "a", 3), (1, good, "en", "a", 3), (2, None, None, None, None), (None, good + " x y z", None, None, None)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, kind)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() > 0) == bool(some)


def test_equal_rows_stay_once_and_are_drawn_one_by_one(spark, monkeypatch):
    kind = table(spark, SF, "documents").schema
    text = [" ".join(f"w{s}{k}" for k in range(10)) for s in range(3)]
    rows = [(None, text[0], "en", "a", 3)] * 4 + [(1, text[1], "en", "a", 3)] * 3 + [(2, text[2], "en", "b", 3)]
    kept = cp.near_duplicates(spark, spark.createDataFrame(rows, kind), SF)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == list(enumerate(text))
    # the last source's target lies below its size
    rows = [(k, text[0], "en", s, 3) for k in range(30) for s in "ab"]
    rows += [(99, text[1], "en", "c", 3)] * 20 + [(None, text[2], "en", "c", 3)] * 10
    docs = spark.createDataFrame(rows, kind)
    monkeypatch.setattr(source_mix, "BUCKET", 4)
    want = {r.source: r.taken for r in source_mix.mix(docs).groupBy("source").agg({"taken": "sum"}).toDF("source", "taken").collect()}
    got = Counter(r.source for r in cp.mix_sources(spark, docs, SF).collect())
    assert {s: 10 * n for s, n in got.items()} == want and 0 < got["c"] < 30


def test_run_is_registered(spark, stages):
    rows = entry.queries()["pipeline"](spark, SF).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((r.doc_id, bytes(r.ids)) for r in stages[5])
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert source_mix.WEIGHTS == (5, 2, 1)
