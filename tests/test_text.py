"""Cleaning, chunking, retrieval and letters."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driver_queries import text as tx
from remitlens.operators import corpus as co
from remitlens.operators import letters as lt
from remitlens.operators import retrieval as rt
from remitlens.plans import appeals_run as ar
from remitlens.session import cut_lineage
from remitlens.sources import documents as dc


@pytest.mark.parametrize(
    "text, size, overlap, want",
    [
        ("aa bb cc dd ee", 8, 3, ["aa bb cc", "cc dd ee"]),
        ("aaaaaa bb c", 4, 0, ["aaaaaa", "bb c"]),
        ("aa bb cc", 5, 100, ["aa bb", "bb cc"]),
        ("   ", 5, 1, []),
    ],
)
def test_chunk_golden(text, size, overlap, want):
    assert co.chunk_words(text.split(), size, overlap) == want


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text("abcdefgh", min_size=1, max_size=12), max_size=60),
    st.integers(4, 40),
    st.integers(0, 50),
)
def test_chunk_properties(words, size, overlap):
    chunks = [c.split() for c in co.chunk_words(words, size, overlap)]
    position = 0  # every chunk is a run of words, starting no later than the previous end
    end = 0
    for i, chunk in enumerate(chunks):
        assert len(" ".join(chunk)) <= size or len(chunk) == 1
        starts = [s for s in range(position, end + 1) if words[s : s + len(chunk)] == chunk]
        assert starts
        if i:
            # the shortest tail of the previous chunk that is worth `overlap`, if it moves on
            previous, tail, back = chunks[i - 1], 0, 0
            while back < len(previous) and tail < overlap:
                back += 1
                tail += len(previous[-back]) + 1
            want = max(begin + 1, end - back)
            assert words[want : want + len(chunk)] == chunk
            begin = want
        else:
            begin = 0
        end = begin + len(chunk)
        position = begin
        if end < len(words):  # greedy: the next word would not fit
            assert len(" ".join([*chunk, words[end]])) > size
    assert end == len(words)


def test_chunk_limits(spark):
    docs = spark.createDataFrame([("a", "x y")], "source string, body string")
    with pytest.raises(ValueError):
        co.chunk_documents(docs, size=100)
    with pytest.raises(ValueError):
        co.chunk_documents(docs, overlap=-1)


def test_clean_html(spark):
    rows = [
        ("a&lt;b&gt;c", "a c"), ("&amp;lt;i&amp;gt;", "&lt;i&gt;"), ("<p>x\x00y</p>\n\t z&nbsp;w", "x y z w"),
        (None, ""), ("&eacute;&#233;&#xE9;", "ééé"), ("2 < 3", "2 < 3"),
    ]
    df = spark.createDataFrame(rows, "h string, want string").withColumn("got", co.clean_html(F.col("h")))
    assert [r.got for r in df.collect()] == [w for _, w in rows]


def test_corpus_end_to_end(spark):
    ncd = spark.createDataFrame(
        [
            ("1", "2", "Sepsis", "", "<b>one</b>", "", None, "two", None),
            ("2", "", "Other", "", "nothing here", None, None, None, None),
            (None, None, "Pneumonia", None, "", None, None, None, None),
        ],
        "NCD_id string, NCD_vrsn_num string, NCD_mnl_sect_title string, ncd_keyword string, itm_srvc_desc string,"
        "indctn_lmtn string, xref_txt string, othr_txt string, rev_hstry string",
    )
    articles = spark.createDataFrame(
        [("9/a", None, "T", "VENTILATOR", "body " * 300, None, None)],
        "article_id string, article_version string, title string, keywords string, description string,"
        "other_comments string, cms_cov_policy string",
    )
    rows = co.build_corpus(ncd, articles).orderBy("source", "chunk_number").collect()
    assert [(r.source, r.source_id, r.version, r.chunk_number, r.chunk_total) for r in rows] == [
        ("article", "9/a", "0", 1, 2), ("article", "9/a", "0", 2, 2), ("ncd", "1", "2", 1, 1),
    ]
    assert rows[2].body == "one two" and rows[0].file_name == "article_9_a_v0_part001.txt"


def test_chunk_header(spark):
    cases = [
        ("source: a\nsource_id: 1\ntitle: t\nchunk: 1/2\nbody\n\nmore", "body\n\nmore"),
        ("source: a\n\ntitle: stays", "title: stays"),
        ("plain", "plain"),
        ("source: a\nchunk: 1/1", "source: a\nchunk: 1/1"),
    ]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r[0] for r in df.select(dc.strip_chunk_header(F.col("t"))).collect()] == [w for _, w in cases]


STOP = ["the", "of"]
CHUNKS = {
    "c1": "The lung of the patient, lung disease", "c2": "heart disease of patients", "c3": "the of",
    "c4": "Ventilator support; ventilator weaning", "c5": "lung lung lung",
}
ASKED = {"q1": "lung disease", "q2": "ventilator", "q3": "unknown words", "q4": "disease of the lung"}


def brute_scores(size):
    def terms(text):
        words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in STOP]
        return Counter(words + [" ".join(p) for p in zip(words, words[1:])])

    tf = {k: terms(t) for k, t in CHUNKS.items()}
    total, df = Counter(), Counter()
    for counts in tf.values():
        total.update(counts)
        df.update(counts.keys())
    vocabulary = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))][:size]
    idf = {t: math.log((1 + len(CHUNKS)) / (1 + df[t])) + 1 for t in vocabulary}

    def vector(counts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in idf}
        length = math.sqrt(sum(w * w for w in raw.values())) or 1
        return {t: w / length for t, w in raw.items()}

    out = {}
    for q, text in ASKED.items():
        asked = vector(terms(text))
        for c, counts in tf.items():
            held = vector(counts)
            score = sum(w * held.get(t, 0) for t, w in asked.items())
            if score > 0:
                out[q, c] = round(score, 9)
    return out


@pytest.mark.parametrize("size", [20_000, 4])
def test_retrieval_against_brute_force(spark, size):
    chunks = spark.createDataFrame(list(CHUNKS.items()), "chunk string, text string")
    asked = spark.createDataFrame(list(ASKED.items()), "query string, text string")
    index = rt.fit_index(chunks, "chunk", STOP, size=size)
    scores = rt.similarities(index, asked, "chunk", "query", STOP)
    got = {(r["query"], r.chunk): round(r.score, 9) for r in scores.collect()}
    want = brute_scores(size)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    best = {(r["query"], r["rank"]): r.chunk for r in rt.top_k(scores, "query", "chunk", 2).collect()}
    for q in ASKED:
        order = sorted((-s, c) for (qq, c), s in want.items() if qq == q)[:2]
        assert [best.get((q, i + 1)) for i in range(len(order))] == [c for _, c in order]


@pytest.mark.parametrize("k, size, first", [(1, 4, 1), (3, 16, 8), (30, 1, 1)])
def test_best_chunks_are_the_top_of_all_scores(spark, monkeypatch, k, size, first):
    """Chunks of all lengths, equal copies, a hot term, a query without a hit and one of many terms."""
    monkeypatch.setattr(rt, "FIRST_BLOCKS", first)
    rng = random.Random(k + size)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.choice([1, 3, 8, 40]))) for _ in range(150)]
    texts += texts[:40] + ["w0"] * 30
    chunks = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk string, text string")
    asked = [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(25)] + ["unseen", "", " ".join(words), "w0", texts[3]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query int, text string")
    index = rt.fit_index(chunks, "chunk", STOP)
    want = rt.top_k(rt.similarities(index, queries, "chunk", "query", STOP), "query", "chunk", k)
    got = rt.best_chunks(rt.block_index(index, "chunk", size), queries, "chunk", "query", STOP, k)
    assert got.columns == want.columns or set(got.columns) == set(want.columns)
    columns = ["query", "rank", "chunk", "score"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_few_pairs_are_scored(spark):
    """Under a tenth of the pairs with a common term, on the driver's documents."""
    d = "/root/testdata/sf0.1"
    index = tx.blocks(spark, d)
    asked = tx._asked(spark, d)
    every = rt.similarities(tx.index(spark, d), asked, "doc_id", "item_id", tx.STOP_WORDS).count()
    scored = rt.promising_scores(index, asked, "doc_id", "item_id", tx.STOP_WORDS, 3).count()
    assert scored < 0.1 * every
    assert index.blocks.select(F.max(F.size("held"))).first()[0] < 100


@pytest.mark.parametrize("terms", [500_000, 0])
def test_pairs_of_a_task_are_bounded(spark, monkeypatch, terms):
    """Scores are added up in tasks of about ``PAIRS`` pairs, and no pair is shuffled for that
    while the terms asked for are few; the rows are those of all scores either way."""
    monkeypatch.setattr(rt, "PAIRS", 100, raising=False)
    monkeypatch.setattr(rt, "ASKED_TERMS", terms, raising=False)
    texts = [(f"c{i:03d}", f"common w{i % 7} w{i % 11}") for i in range(200)]
    chunks = spark.createDataFrame(texts, "chunk string, text string")
    queries = spark.createDataFrame([(i, f"common w{i}") for i in range(9)], "query int, text string")
    fitted = rt.fit_index(chunks, "chunk", STOP)
    made = rt.block_index(fitted, "chunk", 8)
    stored = rt.BlockIndex(made.idf, cut_lineage(made.blocks))
    scores = rt.promising_scores(stored, queries, "chunk", "query", STOP, 3)
    if terms:
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Sort " not in plan
        assert scores.rdd.getNumPartitions() >= 200 * 9 // 100
    want = rt.top_k(rt.similarities(fitted, queries, "chunk", "query", STOP), "query", "chunk", 3)
    columns = ["query", "rank", "chunk", "score"]
    got = rt.top_k(scores, "query", "chunk", 3).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(columns).collect()))


def test_counts_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(rt, "PART_CHARS", 50, raising=False)
    texts = spark.createDataFrame([(i, f"word{i % 3} again word{i % 3}") for i in range(40)] + [(40, None)], "id long, text string")
    counts = rt.term_counts(texts, "id", "text", [])
    assert counts.rdd.getNumPartitions() >= 40 * 17 // 50
    got = Counter((r.term, r.tf) for r in counts.collect())
    assert got[("again", 1)] == 40 and got[("word0", 2)] == 14 and got[("word0 again", 1)] == 14


def test_english_stop_words_and_bigrams_after_removal(spark):
    df = spark.createDataFrame([("State of the Art, a b",)], "t string")
    words = rt.tokens(F.col("t"), rt.english_stop_words())
    assert df.select(words, rt.terms(words)).first()[:] == (["state", "art"], ["state", "art", "state art"])


def test_query_order(spark):
    df = spark.createDataFrame(
        [("drg_shortstay_upcoding", "207", "CO-4", "Medical necessity documentation insufficient",
          "Ventilator support exceeds 96 hours", "COPD exacerbation"), (None, " ", "", None, "r", None)],
        "denial_source string, drg_code string, carc_code string, denial_reason string, rationale string, patient_context string",
    )
    got = [r[0] for r in df.select(lt.retrieval_query(F.lit(" Request. "))).collect()]
    assert got[0] == (
        "drg_shortstay_upcoding 207 CO-4 Medical necessity documentation insufficient "
        "Ventilator support exceeds 96 hours COPD exacerbation Request."
    )
    assert got[1] == "r Request."


def test_redaction(spark):
    cases = [
        ("denial_source; Stage1_Decision", "[redacted]; [redacted]", "denial_source, stage1_decision"),
        ("xdenial_source", "xdenial_source", ""),
        ("DENIAL_RISK_SCORE.", "[redacted].", "denial_risk_score"),
        ("édenial_source denial_source_2", "édenial_source denial_source_2", ""),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = df.select(lt.redact(F.col("t")), lt.redaction_reason(F.col("t"))).collect()
    for row, (_, clean, names) in zip(got, cases):
        assert row[0] == clean
        assert row[1] == (lt.GUARDRAIL_REASON + names if names else "")


def test_false_positive(spark):
    df = spark.createDataFrame(
        [("This may be a false positive and needs review.",), ("False-Positive",), ("complete",), (None,)], "t string"
    )
    assert [r[0] for r in df.select(lt.has_false_positive_caveat(F.col("t"))).collect()] == [True, True, False, False]


def test_classification_priority_and_modes(spark):
    df = spark.createDataFrame(
        [("medical necessity and units exceeded",), ("Missing AUTH",), ("inncdent",), ("carc co-4",), ("hello",)],
        "extracted_text string",
    )
    loose = [r.denial_code for r in lt.classify_letters(df).collect()]
    assert loose == ["D-MUE-001", "D-AUTH-002", "D-MN-003", "D-COVERAGE-004", "D-REVIEW-000"]
    strict = [r.denial_code for r in lt.classify_letters(df, whole_words=True).collect()]
    assert strict[2] == "D-REVIEW-000"


def test_letters_to_packets(spark):
    chunks = spark.createDataFrame(
        [("ncd", "1", "1", "Lung", 1, "medical necessity of lung care"), ("ncd", "2", "1", "Heart", 1, "cardiac care")],
        "source string, source_id string, version string, title string, chunk_number int, body string",
    )
    letters = spark.createDataFrame(
        [("a", "denied: medical necessity of lung care", None, "x false positive"), ("b", "zzz", "ctx", "")],
        "letter_id string, extracted_text string, patient_context string, caveat_notes string",
    )
    index = ar.corpus_index(chunks)
    out = {r.letter_id: r for r in ar.appeal_letters(letters, "letter_id", index, chunks).collect()}
    a, b = out["a"], out["b"]
    assert a.policy_excerpts.startswith("--- Policy Excerpt 1 (score=") and "NCD 1 — Lung" in a.policy_excerpts
    assert "denial code D-MN-003 regarding Medical necessity" in a.appeal_letter
    assert a.context_snapshot["caveat_warning"] == "true" and a.context_snapshot["supporting_context_source"] == "none"
    assert lt.CHECKLIST_BY_REASON[1][1] in a.evidence_checklist and lt.CHECKLIST_CONTEXT in a.evidence_checklist
    assert b.context_snapshot["supporting_context_source"] == "csv_context"
    assert not any(f in a.appeal_letter for f in lt.FORBIDDEN_FIELDS)


def test_letter_text(spark):
    cases = [
        (b" a \n b ", "a b"), (b"", ""), (b"\xff\xfe", "ÿþ"), (b"ok\xff", "ok"), (b" \n ", "Uploaded file: f"),
    ]
    df = spark.createDataFrame([(bytearray(c),) for c, _ in cases], "c binary")
    assert [r[0] for r in df.select(dc.letter_text(F.col("c"), F.lit("f"))).collect()] == [w for _, w in cases]


def test_dedup_keeps_first_corpus(spark):
    df = spark.createDataFrame(
        [(1, 5, "s", "i", "1", 1, "x"), (0, 7, "s", "i", "1", 1, "x"), (1, 6, "s", "i", "1", 2, "x")],
        "corpus int, chunk_key int, source string, source_id string, version string, chunk_number int, body string",
    )
    assert sorted((r.corpus, r.chunk_key) for r in rt.dedup_chunks(df).collect()) == [(0, 7), (1, 6)]


def test_stored_tables_are_small_in_any_session(spark, tmp_path, monkeypatch):
    """A session that the driver makes has Spark's default codec, with which the stored counts took half as much again."""
    from driver_queries import prepared as pt
    from remitlens import session as ss

    before = spark.conf.get("spark.sql.parquet.compression.codec")
    monkeypatch.setattr(ss, "fresh_path", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(pt, "fresh_path", lambda _, name: str(tmp_path / name))
    spark.conf.set("spark.sql.parquet.compression.codec", "snappy")
    try:
        assert ss.cut_lineage(spark.range(5), "cut").count() == 5
        assert pt.stored(spark, str(tmp_path), "kept", lambda s, _: s.range(7)).count() == 7
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
    files = [*(tmp_path / "cut").glob("*.parquet"), *(tmp_path / "kept").glob("*.parquet")]
    assert files and all(".zstd." in f.name for f in files)
