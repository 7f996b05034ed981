"""Host quality, source mixing, chat collapse and URL filter."""

import random
from collections import Counter, defaultdict

import oracle_compare as oc
import pytest
from helpers import WORDS, own_figures
from pyspark.sql import functions as F

from remitlens.llm import chat_collapse, host_quality, queries, source_mix, url_filter
from remitlens.llm.common import table

SF = "/root/testdata/sf0.001"
NATIVE = ["op4_host_quality", "op9_chat_collapse", "op10_url_filter"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert oc.differences(spark, oc.connect(SF), SF, queries.QUERIES[name], queries.ORACLE[name]) == ""


@pytest.mark.parametrize("name", NATIVE)
def test_plans_are_native(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "InPandas", "InArrow", "CartesianProduct", "NestedLoop"))


# --- quality ---------------------------------------------------------------------


def quality(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, source string, n_words int, kept boolean")
    return host_quality.judge(df, **options).collect()


def test_own_figures(spark):
    draw = random.Random(6)
    texts = [
        None, "", " \n\t\x0b", "a", "a b c d e", "a b c d e f a b c d e", "x " * 40, "a a a a a a", "one\none\n\n \n one\none ",
        "a\rb\n a\rb", "# * $ % & | < > #tag", "é" * 2000, "w" * 100_000, "é\u00a0è \u2003 x", "a b c d e " * 3000,
        "\u2028x\n\u2028x", "😀 b c d e f 😀 b c d e",
    ]
    texts += ["".join(draw.choice(["a ", "b ", "c ", "#", "\n", "  ", "d e "]) for _ in range(draw.randint(1, 90))) for _ in range(60)]
    got = {r.doc_id: r for r in quality(spark, [(i, t, "s") for i, t in enumerate(texts)])}
    for i, t in enumerate(texts):
        r = got[i]
        own = own_figures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own, repr(t)[:80]
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(i, "short" if i % 10 else good + str(i), "bad.example") for i in range(200)]
    rows += [(1000 + i, good + str(i), f"h{i % 40}.example") for i in range(2000)]
    rows += [(5000, "short", "lonely"), (5001, good, None), (5002, "short", None), (5001, good, None), (None, good, "h1.example")]
    got = quality(spark, rows)
    assert len(got) == len(rows)
    kept = defaultdict(set)
    for r in got:
        kept[r.host].add((r.base_failed, r.kept))
    assert kept["bad.example"] == {(True, False), (False, False)}
    assert kept["h1.example"] == {(False, True)}
    assert kept["lonely"] == {(True, False)}
    assert kept[None] == {(False, True), (True, False)}


def test_one_failure_does_not_condemn_a_small_host(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(i, good, f"h{i % 50}") for i in range(3000)] + [(9000, "short", "tiny"), (9001, good, "tiny"), (9002, "short", "tiny")]
    assert {r.doc_id: r.kept for r in quality(spark, rows) if r.host == "tiny"} == {9000: False, 9001: True, 9002: False}


def test_quality_of_an_empty_table(spark):
    assert quality(spark, []) == []


# --- mixing -----------------------------------------------------------------------


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int")
    return source_mix.mix(df, **options)


def water_level(sizes, weights, most):
    """Targets by filling up source after source: reshare the excess until none is above."""
    total, left, out = sum(sizes), set(range(len(sizes))), {}
    while True:
        free = total - sum(out.values())
        share = {i: free * weights[i % len(weights)] / sum(weights[j % len(weights)] for j in left) for i in left}
        over = {i for i in left if share[i] > most * sizes[i]}
        if not over:
            return {**out, **share}
        for i in over:
            out[i] = most * sizes[i]
        left -= over


@pytest.mark.parametrize("counts", [[5, 50, 500, 50], [400, 300, 300], [3, 3, 3, 900], [40]])
def test_targets_and_taken_words(spark, counts):
    draw = random.Random(len(counts))
    rows, k = [], 0
    for s, n in enumerate(counts):
        for _ in range(n):
            rows.append((k, "w " * draw.choice([0, 3, 20, 40, 200]), f"s{s}" if s else None))
            k += 1
    rows.append((k, "w " * 4000, "s1"))
    got = mixed(spark, rows, bucket=60).collect()
    again = mixed(spark, list(reversed(rows)), bucket=60).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    words = Counter()
    for _, t, s in rows:
        words[s] += len(WORDS.findall(t))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    want = water_level([words[s] for s in order], source_mix.WEIGHTS, 3)
    taken, single = Counter(), defaultdict(list)
    for r in got:
        taken[r.source] += r.taken
        single[r.source].append(r.size)
        assert r.taken in (0, r.copies * r.size) and r.copies <= 3
    for i, s in enumerate(order):
        assert next(r.target for r in got if r.source == s) == pytest.approx(want[i])
        # short by less than the smallest document that was left
        assert want[i] - min(max(single[s]), 210) <= taken[s] <= want[i] + 1e-6


def test_inclusion_follows_the_weight(spark):
    rows = [(i, "w " * 10, "a") for i in range(3000)] + [(3000 + i, "w " * 10, "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("q", 1 + F.col("doc_id") % 2 * 3)
    got = source_mix.mix(df, weights=(1, 3), weight_col="q").where("source = 'a'")
    share = dict(got.groupBy(F.col("doc_id") % 2).agg(F.avg("copies")).collect())
    assert share[0] == pytest.approx(0.2, abs=0.04) and share[1] == pytest.approx(0.8, abs=0.04)


def test_mix_of_odd_tables(spark):
    assert mixed(spark, []).count() == 0
    assert [r.taken for r in mixed(spark, [(1, None, "a"), (2, "", None)]).collect()] == [0, 0]
    twice = mixed(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")]).collect()
    assert sum(r.taken for r in twice) == 5


# --- chats ------------------------------------------------------------------------


def chats(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, idx int, part string")
    return chat_collapse.collapse(df, **options).collect()


def talk(conv, *texts, step=1, role="user"):
    return [(conv, step * k, role, t) for k, t in enumerate(texts)]


def test_prefixes_go_and_the_longest_stays(spark):
    rows = talk(1, "a") + talk(2, "a", "b", step=5) + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a", "b", "c")
    rows += talk(6, "b", "a") + talk(7, "a", "b", role=None) + talk(8, "a", None) + talk(9, "a", "") + [(None, 0, "user", "zz")]
    got = {r.conv_id: r for r in chats(spark, rows)}
    assert sorted(got) == [3, 4, 6, 7, 8, 9] and got[3].n_copies == 2
    assert got[3].rendered == "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert got[7].rendered.startswith("<||>\na")


def test_long_conversations_come_in_parts(spark):
    texts = [f"t{k % 7}" for k in range(1000)]
    rows = talk(1, *texts) + talk(2, *texts[:700]) + talk(3, *texts[1:]) + [(4, None, "user", "a"), (4, None, "user", "a"), (4, 3, "user", "b")]
    got = chats(spark, rows, block=64)
    assert Counter(r.conv_id for r in got) == {1: 16, 3: 16, 4: 1}
    whole = "".join(r.rendered for r in sorted(got, key=lambda r: r.part) if r.conv_id == 1)
    assert whole == "".join(f"<|user|>\n{t}<|end|>\n" for t in texts)
    assert next(r for r in got if r.conv_id == 4).rendered.count("user") == 3


def test_chats_of_an_empty_table(spark):
    assert chats(spark, []) == []


# --- URLs --------------------------------------------------------------------------


def test_rules_and_list(spark):
    urls = {
        "http://a.net": (None, "allow"), "http://a.net/": ("net/", "block"), "HTTP://A.NET/x?y": ("net/", "block"),
        "http://b.example.net/en/": ("example.net/en/", "allow"), "http://b.example.net/en": ("net/", "block"),
        "http://badexample.net/en/": ("net/", "block"), "http://example.com/de/1#x": ("example.com/de/", "block"),
        "http://x.org/fr/": ("org/fr/", "allow"), "http://x.org/fr": (None, "allow"), "x.net/": (None, "allow"), None: (None, "allow"),
        "": (None, "allow"), "http://ok.com/a/?utm_source=x&b=1&ref=z#f": (None, "block"), "https://OK.com/a?b=1": (None, "block"),
        "http://ok.com/A?b=1": (None, "allow"), "http://ok.com/a": (None, "allow"), "a://" + "y" * 50_000 + ".net/": ("net/", "block"),
    }
    rows = [(i, u, "r", "v") for i, u in enumerate(urls)] * 2 + [(None, "http://a.net/", "r", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    listed = spark.createDataFrame([("http://ok.com/a?b=1",), (None,), ("http://ok.com/a?b=1#2",)], "url string")
    for blocks in (1, url_filter.BLOCKS):  # one block lets nearly all through to the exact join
        got = url_filter.judge(pages, listed, blocks=blocks).collect()
        assert len(got) == len(rows)
        said = {r.page_id: (r.rule, r.verdict) for r in got if r.page_id is not None}
        assert said == dict(enumerate(urls.values()))
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}


def test_filter_passes_every_listed_url(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("http://h.com/"), "id").alias("url"))
    pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://H.com/"), "id", F.lit("#x")).alias("url"))
    for blocks in (64, url_filter.BLOCKS):
        got = url_filter.judge(pages, listed, blocks=blocks).groupBy("verdict").agg(F.count("*"), F.max("page_id")).collect()
        assert sorted(map(tuple, got)) == [("allow", 20_000, 39_999), ("block", 20_000, 19_999)]
    words = url_filter.blocked_bloom(listed.select(url_filter.canonical(F.col("url")).alias("listed_url")), 64)
    assert words.count() == 64


def test_registered_tables_are_read_whole(spark):
    for name, of in (("op4_host_quality", "documents"), ("op8_source_mix", "documents"), ("op10_url_filter", "pages")):
        assert queries.QUERIES[name](spark, SF).count() == table(spark, SF, of).count()
