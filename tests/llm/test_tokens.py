"""Token counts, BPE tree and packing against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from remitlens.llm import bpe_tree, packing, token_counts
from remitlens.llm.common import table
from remitlens.llm.ranks import encoder

SF = "/root/testdata/sf0.001"
PARTS = [
    "<|endoftext|>", "<|endof", "don't", " 'll", "'", "s", "  ", "\n\n", "\t", "é", "漢字", "。", "12", "3", "a" * 50,
    "!?", "\x1c", "\x85", " ", " ", " ", "😀", "é", "the", " of", "'re", "\r\n", "x",
]
library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ranks = encoder(token_counts.VOCABULARY, token_counts.SPECIALS)
multi = encoder(bpe_tree.VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_spliced_ids_are_the_librarys(text):
    want = library.encode(text, add_special_tokens=False).ids
    assert token_counts.spliced_ids(text, ranks, chunk=16, overlap=4) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=60).map("".join))
def test_tree_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe_tree.tree_encode(text, multi, leaf=7)
    assert ids == multi.exact.encode_ordinary(text)
    assert bpe_tree.tree_decode(ids, multi, leaf=3) == text.encode()


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000 + "x", "ab1" * 40_000, "漢" * 60_000, "<|endoftext|>" * 9000])
def test_huge_texts(text):
    assert token_counts.spliced_ids(text, ranks) == library.encode(text, add_special_tokens=False).ids
    assert bpe_tree.tree_encode(text, multi) == multi.exact.encode_ordinary(text)


def rows(spark, *texts):
    data = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "clash", 1), (0, texts[0], "clash", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens int")


def test_token_counts_of_odd_rows(spark):
    got = token_counts.count_tokens(rows(spark, None, "", "a b", "word " * 30_000)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens > 0) for r in got) == [
        (False, 0, 0, False), (False, 0, 0, False), (False, 1, 0, False), (False, 2, 3, True), (False, 3, 150_000, True),
        (True, 0, 5, True),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty).count() == 0


def test_registered_counts(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op3_token_counts(spark, SF).collect()}
    for doc_id, text in table(spark, SF, "documents").select("doc_id", "text").collect():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got.pop(doc_id) == (len((text or "").encode()), n, n > 512)
    assert not got


def test_registered_tree(spark):
    got = {r.doc_id: tuple(r)[1:] for r in bpe_tree.op5_bpe_tree(spark, SF).collect()}
    for doc_id, text in table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = multi.exact.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.pop(doc_id) == (len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest())
    assert not got


def test_tree_of_odd_rows(spark):
    got = bpe_tree.encode_documents(rows(spark, None, "", "a b")).collect()
    assert len(got) == 5 and all(bytes(r.decoded).decode() in ("", "a b", "no id") for r in got)
    assert bpe_tree.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_fit_takes_the_tightest_row():
    draw = random.Random(4)
    for _ in range(100):
        lengths = [draw.randint(1, 64) for _ in range(draw.randint(0, 80))]
        packed = packing.best_fit(lengths, 64)
        assert sorted(sum(packed, [])) == list(range(len(lengths)))
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [k for k in range(len(rooms)) if rooms[k] >= lengths[i]]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= lengths[i]
            else:
                rooms.append(64 - lengths[i])
        assert sorted(64 - sum(lengths[i] for i in row) for row in packed) == sorted(rooms)


@pytest.mark.parametrize("row, block", [(64, 1 << 23), (64, 500), (2048, 1 << 23)])
def test_packing_is_lossless(spark, row, block):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, row=row, block_tokens=block).collect()
    pieces = {}
    for r in packed:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == row and r.seq_lengths[0] == 0 and r.seq_lengths[-1] == r.n_tokens <= row
        assert r.n_segments == len(r.doc_ids) == len(r.pieces) == len(r.seq_lengths) - 1
        assert (ids[r.n_tokens :] == packing.END).all() and not places[r.n_tokens :].any()
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.seq_lengths, r.seq_lengths[1:]):
            assert (d, k) not in pieces and (places[a:b] == np.arange(b - a)).all()
            pieces[d, k] = ids[a:b].tolist()
    enc = encoder(packing.VOCABULARY)
    for doc_id, text in docs.collect():
        ids, k = [], 0
        while (doc_id, k) in pieces:
            ids += pieces.pop((doc_id, k))
            k += 1
        assert ids == [*enc.encode(text or ""), packing.END]
    assert not pieces
    assert len({r.pack_id for r in packed}) == len(packed)


def test_packing_of_odd_rows(spark, tmp_path):
    packed = packing.pack_documents(rows(spark, None, "", "a b"), row=8)
    packing.write_packed(packed, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed")).collect()
    assert sorted((x is None, x or 0) for r in back for x in r.doc_ids) == [
        (False, 0), (False, 0), (False, 1), (False, 2), (True, 0)
    ]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
