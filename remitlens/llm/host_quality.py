"""Quality rules judged per document and per host.

A document's own figures come from built-in string and array functions. Then the
failures of each rule are counted by host, the host's rate is shrunk towards the
mean of all hosts with a beta prior fitted to the hosts themselves (method of
moments), and a host whose shrunk rate for some rule is above ``most`` is bad:
its documents go too. Host verdicts are joined back to the documents.

Nulls: a null text has no words and fails; a null host is no host, so such
documents are judged by their own figures alone. Every row gets a result, also
repeated ones; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

from .common import GAP, table

SHINGLE = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Rules whose failures count against a host.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines")
MOST = 0.5
#: The prior weighs as much as so many documents, at least and at most.
LEAST_PRIOR, MOST_PRIOR = 10.0, 1e6


def _repeat_words(s: Column) -> Column:
    """Words covered by the windows of ``s``, sorted (window, place) pairs, that occur twice."""
    twice = F.zip_with(
        s,
        F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    return F.sort_array(F.array_distinct(F.flatten(twice)))


def own_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Figures of every document: words, characters, symbols, repeated lines and words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    word = "[^ ]++"
    # a window starts after a blank; a negated look-behind would also match inside a surrogate pair
    windows = rf"(?:^|(?<= ))(?=({word}(?: {word}){{{SHINGLE - 1}}}))"
    lines = r"(?dm)^[\t\x0B\f\r ]*+[^\x20\x09-\x0D][^\n]*"
    base = (
        docs.select(F.col(id_col), F.col(host_col).cast("string").alias("host"), text.alias("text"))
        .withColumn("flat", F.trim(F.regexp_replace("text", GAP, " ")))
        .withColumn("lines", F.regexp_extract_all("text", F.lit(lines), F.lit(0)))
        .withColumn("windows", F.regexp_extract_all("flat", F.lit(windows), F.lit(1)))
    )
    chars = F.length(F.replace("flat", F.lit(" "), F.lit("")))
    figures = base.select(
        id_col,
        "host",
        F.when(F.col("flat") == "", 0).otherwise(F.length("flat") - chars + 1).cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.length(F.regexp_replace("flat", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        # only texts that repeat a window go on to look where
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ).alias("pairs"),
    ).withColumn("places", F.when(F.col("pairs").isNotNull(), _repeat_words(F.col("pairs"))))
    gaps = F.zip_with(
        "places",
        F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1))),
        lambda a, b: F.least(F.lit(SHINGLE), F.coalesce(b - a, F.lit(SHINGLE))),
    )
    repeated = F.when(F.col("places").isNotNull(), F.aggregate(gaps, F.lit(0), lambda x, y: x + y)).otherwise(0)
    return figures.withColumn("n_repeat_words", repeated.cast("long")).drop("pairs", "places")


def with_rules(figures: DataFrame) -> DataFrame:
    """One boolean per rule, and ``base_failed`` for the two that reject a document."""
    return figures.select(
        "*",
        (F.col("n_words") < LEAST_WORDS).alias("few_words"),
        (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")).alias("repeated_words"),
        (5 * F.col("n_symbols") > F.col("word_chars")).alias("symbols"),
        (2 * F.col("n_dup_lines") > F.col("n_lines")).alias("repeated_lines"),
    ).withColumn("base_failed", F.col("few_words") | F.col("repeated_words"))


def host_verdicts(ruled: DataFrame, most: float = MOST) -> DataFrame:
    """Per host: documents, shrunk failure rate of each rule and ``bad``.

    Only four sums per rule over all hosts go to the driver. Prior of a rule, with
    m the mean and v the weighted variance of the hosts' rates beyond what drawing so
    few documents gives: a + b = m (1 - m) / v - 1, held between ``LEAST_PRIOR`` and
    ``MOST_PRIOR`` (hosts alike: the highest).
    """
    hosts = (
        ruled.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    )
    sums = hosts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count("*").alias("hosts"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in RULES],
        *[F.coalesce(F.sum(F.col(r) * F.col(r) / F.col("n")), F.lit(0.0)).alias(f"{r}_square") for r in RULES],
    ).first()
    bad = F.lit(False)
    for r in RULES:
        mean = sums[r] / sums["n"] if sums["n"] else 0.0
        drawn = mean * (1 - mean) * sums["hosts"] / sums["n"] if sums["n"] else 0.0
        spread = sums[f"{r}_square"] / sums["n"] - mean * mean - drawn if sums["n"] else 0.0
        weight = MOST_PRIOR
        if spread > 1e-12:
            weight = min(max(mean * (1 - mean) / spread - 1, LEAST_PRIOR), MOST_PRIOR)
        rate = (F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        hosts = hosts.withColumn(f"{r}_rate", rate)
        bad = bad | (rate > most)
    return hosts.withColumn("bad", bad).drop(*RULES)


def judge(
    docs: DataFrame, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Figures, rules, ``base_failed`` and ``kept`` of every document."""
    ruled = cut_lineage(with_rules(own_figures(docs, id_col, text_col, host_col)), "quality")
    bad = host_verdicts(ruled, most).where("bad").select(F.col("host"), F.col("bad").alias("host_bad"))
    judged = ruled.join(bad, "host", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("host_bad").isNull()).drop("host_bad")


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _prior_sql(rule: str) -> str:
    return f"""
    {rule}_prior as (
      select m, case when v > 1e-12 then least(greatest(m * (1 - m) / v - 1, {LEAST_PRIOR}), {MOST_PRIOR}) else {MOST_PRIOR} end w
      from (select m, s / n - m * m - m * (1 - m) * hosts / n v
            from (select sum({rule})::double / sum(n) m, sum({rule}::double * {rule} / n) s, sum(n) n, count(*) hosts from hosts)))"""


ORACLE = rf"""
with d as (select doc_id, source host, coalesce(text, '') t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
wins as (select doc_id, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') g
         from (select doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) i from d)),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) n from wins),
cov as (select doc_id, count(distinct p) c from (select doc_id, unnest(range(i, i + {SHINGLE})) p from rep where n > 1) group by 1),
fig as (
  select d.doc_id, host, len(w) n_words, length(array_to_string(w, '')) word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
         len(ls) - len(list_distinct(ls)) n_dup_lines, len(ls) n_lines, coalesce(c, 0) n_repeat_words
  from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d) d
  left join cov using (doc_id)),
ruled as (
  select *, n_words < {LEAST_WORDS} few_words, 100 * n_repeat_words > {MOST_REPEATED} * n_words repeated_words,
         5 * n_symbols > word_chars symbols, 2 * n_dup_lines > n_lines repeated_lines from fig),
hosts as (
  select host, count(*) n, {", ".join(f"sum({r}::int) {r}" for r in RULES)} from ruled where host is not null group by 1),
{",".join(_prior_sql(r) for r in RULES)},
bad as (
  select host from hosts where {" or ".join(f"({r} + (select m * w from {r}_prior)) / (n + (select w from {r}_prior)) > {MOST}" for r in RULES)})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       few_words or repeated_words base_failed,
       not (few_words or repeated_words) and coalesce(host not in (select host from bad), true) kept
from ruled
"""
