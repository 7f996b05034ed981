"""Merkle manifest, concatenating packer and prefix trie against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import oracle_compare as oc
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from remitlens.llm import concat_cut, merkle, prefix_trie, words
from remitlens.llm.common import crc32_sql, table
from remitlens.llm.words import WordEncoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, key int, pos string"
library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def con():
    return oc.connect(SF)


@pytest.mark.parametrize("key", [0, 7, 42, 1234567890123, -5])
def test_crc32_in_sql(key):
    assert duckdb.execute(f"select {crc32_sql(str(key).join(chr(39) * 2))}").fetchall() == [(crc32(str(key).encode()),)]


# --- Merkle manifest


def hexed(parts):
    return sha256("".join(parts).encode()).hexdigest()


def folded(nodes):
    """(what remains, the siblings of each node on the way up)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % 3
            proofs[i].append((nodes[run:k], nodes[k + 1 : run + 3]))
            at[i] = k // 3
        nodes = [hexed(nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain_manifest(rows):
    def leaf(r, text):
        values = [r[0], r[1], r[2], r[3], text]
        return hexed("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    by_source = defaultdict(list)
    for r in rows:
        text = r[4]
        if text is not None and r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by_source[r[1]].append(((r[0] is not None, r[0] or 0), leaf(r, r[4]), leaf(r, text), r[0]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: folded([x[1] for x in sorted(by_source[s])]) for s in names}
    root, above = folded([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, above):
        for (_, own, other, key), lower in zip(sorted(by_source[s]), trees[s][1]):
            siblings, node = [], other
            for left, right in lower + upper:
                siblings += left + right
                node = hexed([*left, node, *right])
            out.append((key, own, trees[s][0], root, hexed(siblings), node, node == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("n, height", [(1, 1), (40, 2), (300, 1), (300, 5)])
def test_manifest_is_the_plain_tree(spark, n, height):
    rng = random.Random(n)
    # one hot source, null and odd values, ids that repeat with equal and with other texts
    rows = [
        (rng.choice([None, 3, k, k]), rng.choice(["a", "a", "a", "", None, "é"]), rng.choice(["en", None]), rng.choice([None, 5]),
         rng.choice([None, "", "x\ny", "x" * 1000, "é\n"]))
        for k in range(n)
    ]
    rows += rows[: n // 4]
    docs = spark.createDataFrame([(*r, "clash", 1, "p") for r in rows], DOCS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = merkle.manifest(docs, {"text": F.coalesce(tampered, F.col("text"))}, height=height)
    assert ordered(map(tuple, got.collect())) == ordered(plain_manifest(rows))


def test_manifest_proofs_and_other_ids(spark):
    docs = spark.createDataFrame([(f"d{k}", "s", None, k, "t") for k in range(11)], "doc_id string, source string, lang string, n_chars int, text string")
    for r in merkle.manifest(docs, height=1, proofs=True).collect():
        node = r.leaf
        for left, right in zip(r.lefts, r.rights):
            node = hexed([left, node, right])
        assert node == r.root == r.folded_root and r.verified
        assert r.proof_sha256 == hexed(x for pair in zip(r.lefts, r.rights) for x in pair)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_is_the_sql(spark, con):
    assert oc.differences(spark, con, SF, merkle.op11_merkle_manifest, merkle.ORACLE) == ""


# --- words of the library

PARTS = [
    "<|endoftext|>", "<|endof", "Don't", "'ll", "'", "s", "  ", "\n\n", "\t", "é", "漢字", "。", "12", "3", "a" * 50, "!?",
    "\x1c", "\x85", " ", " ", "　", "😀", "é", "́", "the", " of", "'re", "\r\n", "x", "İ", "Σ", "ß", "​", " ",
]
tiny = WordEncoder("word_bpe_49k.json", most=60)
whole = WordEncoder("word_bpe_49k.json")
ended = WordEncoder("word_bpe_49k.json", 1)
PIECES = st.lists(st.sampled_from(PARTS) | st.text(max_size=3) | st.text("aZéÉİıŉǅß<|'9.#÷́ ", max_size=6), max_size=50)


@settings(max_examples=800, deadline=None)
@given(PIECES.map("".join))
def test_word_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    want = library.encode(text, add_special_tokens=False).ids
    assert whole.encode(text).tolist() == want
    assert tiny.encode(text).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES.map("".join), max_size=6))
def test_word_ids_of_several_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, ends = ended.encode_all(texts)
    cuts = [0, *ends.tolist()]
    assert len(cuts) == len(texts) + 1 and cuts[-1] == len(ids)
    for text, a, b in zip(texts, cuts, cuts[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids + [1]


def test_word_ids_of_every_latin_letter():
    """Alone, in capitals, before and after signs and digits."""
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA0, 0x250))]
    text = " ".join(f"{a} {a}{a} x{a} {a}X 9{a}. {a}#{b}" for a, b in zip(letters, letters[7:] + letters[:7]))
    assert whole.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_ids_of_long_words():
    text = "a b " + "x" * 5000 + " c " + "漢" * 3000 + " d"
    assert whole.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_ids_of_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 40)
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choices(PARTS, k=80))
        assert whole.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_white_space_is_the_librarys():
    """Every character alone between two letters: the splitter parts them only where the library does."""
    for c in map(chr, range(0x3100)):
        if c not in "\x1c\x1d\x1e\x1f":
            assert whole.encode(f"a{c}b").tolist() == library.encode(f"a{c}b", add_special_tokens=False).ids


def test_word_ids_of_the_tables():
    for r in duckdb.execute(f"select text from '{SF}/documents.parquet'").fetchall():
        assert whole.encode(r[0] or "").tolist() == library.encode(r[0] or "", add_special_tokens=False).ids


# --- concatenate and cut


def plain_pieces(rows, size):
    """Rows are (id, text), ids differ."""
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        start = 0
        while start < len(ids):
            n = min(size - at % size, len(ids) - start)
            out.append((key, start, n, crc32(ids[start : start + n].tobytes()), len(ids), at // size, at % size))
            start, at = start + n, at + n
    return out


def pieces(records):
    rows = records.select("sequence_id", F.explode("pieces").alias("p")).collect()
    return [(r.p.doc_id, r.p.start, r.p.length, r.p.ids_crc32, r.p.doc_tokens, r.sequence_id, r.p.offset) for r in rows]


def test_pieces_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = concat_cut.op12_concat_cut(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_pieces(rows, 2048))


@pytest.mark.parametrize("tasks", [1, 64])
def test_windows_do_not_depend_on_the_tasks(spark, tasks):
    rng = random.Random(5)
    rows = [(k if k else None, rng.choice([None, "", "a b c", "long words " * rng.randrange(200), "<|endoftext|>"])) for k in range(120)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, offset int").repartition(tasks)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records = concat_cut.records(docs, row=32)
        assert ordered(pieces(records)) == ordered(plain_pieces(rows, 32))
        made = concat_cut.sequences(records, row=32).orderBy("sequence_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    flat = np.concatenate([np.frombuffer(r.ids, "<u4")[: r.length] for r in made])
    want = []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want += library.encode(text or "", add_special_tokens=False).ids + [1]
    assert flat.tolist() == want
    assert [r.sequence_id for r in made] == list(range(-(-len(want) // 32)))
    for r in made:
        assert len(r.ids) == 4 * (32 if r.length & (r.length - 1) else r.length)
        assert r.seq_lengths[0] == 0 and r.seq_lengths[-1] == r.length
        assert np.diff(r.seq_lengths).tolist() == [p.length for p in r.pieces]
        assert set(np.frombuffer(r.ids, "<u4")[r.length :].tolist()) <= {1}


def test_padding_stops_at_a_power_of_two(spark):
    # 8 ids and 5 ids, windows of 16
    for texts, size in ((["a b c d e f g"], 8), (["a b c d"], 16)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        (one,) = concat_cut.sequences(concat_cut.records(docs, row=16), row=16).collect()
        assert len(one.ids) == 4 * size


def test_repeated_rows_and_no_rows_packed(spark):
    docs = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (7, None), (None, "d")] * 30, "doc_id long, text string")
    got = pieces(concat_cut.records(docs, row=64))
    assert sum(p[2] for p in got) == 30 * (4 + 4 + 1 + 2)
    filled = sorted((p[5], p[6], p[2]) for p in got)
    assert all(a[0] < b[0] or a[1] + a[2] == b[1] for a, b in zip(filled, filled[1:]))
    assert concat_cut.records(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wide_ids_are_stored_whole():
    for ids in ([], [1, 65535], [1, 65536, 1 << 31]):
        assert concat_cut._loaded(concat_cut._stored(np.asarray(ids, "<u4"))).tolist() == ids


# --- prefix trie


@st.composite
def shapes(draw):
    """Depths of a shard's nodes in preorder, and of the node that follows."""
    depths = [draw(st.integers(0, 5))]
    for _ in range(draw(st.integers(0, 60))):
        depths.append(draw(st.integers(0, depths[-1] + 1)))
    return depths, draw(st.integers(-1, depths[-1] + 1))


@settings(max_examples=300, deadline=None)
@given(shapes(), st.sampled_from([2, 4, 64]))
def test_findclose_is_the_plain_scan(shape, block):
    depths, after = shape
    trie = prefix_trie.Parentheses(np.array(depths), after, block)
    ends = [*depths, after]
    for i, (d, place) in enumerate(zip(depths, trie.findclose())):
        end = next((j for j in range(i + 1, len(ends)) if ends[j] <= d), None)
        assert (place < 0) == (end is None)
        assert end is None or trie.rank[place] == end
    want = {}
    for j, d in enumerate(ends):
        for level in range(d, depths[0]):
            want.setdefault(level, j) if j else None
    levels, at = trie.foreign_closes()
    assert dict(zip(levels.tolist(), trie.rank[at].tolist())) == want


def plain_trie(turns):
    """Turns are (conv, turn, role, text) with turn numbers that differ in a conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = crc32(str(c).encode()) % 9
        path = tuple(convs.get(c - c % 5, [])[:h] + convs[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        worth = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += worth
    return [
        (own[0], len(node), members[node[:-1]][0] if node else None, len(own), children[node], leaves[node], saved[node],
         sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, own in members.items()
    ]


TURNS = "conv_id long, turn long, role string, text string, depth string, content int"


@pytest.mark.parametrize("seed, shard", [(1, 1), (2, 7), (3, None)])
def test_trie_is_the_plain_one(spark, seed, shard):
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        # copies, prefixes of one another, gaps between turns, a turn without a number
        n = rng.choice([1, 2, 3, 5, 9, 14])
        numbers = rng.sample(range(100), n)
        if rng.random() < 0.2:
            numbers[0] = None
        rows += [(c, t, rng.choice(["u", "u", None]), rng.choice(["hi", "é", None, "hi"])) for t in numbers]
    rows += [(None, 0, "u", "lost"), (1000, 0, "u", "x" * 3000), (1002, 0, "u", "x"), (1002, 1, "u", "y")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(5)
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(turns)), shard=shard)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_trie(rows)))


def test_trie_of_one_long_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "WINDOW", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    rows = [(5, t, "u", f"turn {t}") for t in range(700)]
    rows += [(10 + 5 * k, t, "u", "same") for k in range(200) for t in range(3)]
    # logged again after every few turns
    rows += [(2000 + 5 * k, t, "u", f"turn {t}") for k in range(20) for t in range(10 * k + 1)]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(turns)), shard=64)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_trie(rows)))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(spark.createDataFrame([], TURNS)))).collect() == []
    # no base to start from, and fewer turns than are replaced
    short = [c for c in range(1, 200) if c % 5 and crc32(str(c).encode()) % 9 > 1][:4]
    rows = [(c, 0, "u", "x") for c in short]
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(spark.createDataFrame([(*r, "", 1) for r in rows], TURNS))))
    assert list(map(tuple, got.collect())) == plain_trie(rows)
    assert got.first().n_convs == 4


def test_trie_is_the_sql(spark, con):
    assert oc.differences(spark, con, SF, prefix_trie.op13_prefix_trie, prefix_trie.ORACLE) == ""
