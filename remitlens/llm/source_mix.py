"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: the total shared by weight, at most ``most``
times the source's own size, the excess reshared by weight. A document is first
taken in whole as often as every document of its source certainly is (the whole
part of target / size). The rest of the target is a sample without replacement:
each document draws a reproducible random number u and ranks by
(u / (1 - u)) / (p / (1 - p)), random odds over the odds of its inclusion
probability p. Inclusion is unequal: a document longer than the rest of the target
has none, the others share it in proportion to their ``weight``. The sample takes
documents in rank order while their words fit; what is then left is offered, in the
same order, to the documents that still fit, ``FILLS`` times over.

Ranks are summed in buckets of about ``BUCKET`` documents: sums within a bucket, and
over the buckets before it, so no task sorts a whole source.

A null text has size 0 and is never taken beyond whole copies of no words; a null
source is a source of its own, last in order. Rows that repeat take part one by one
(equal ids draw the same number and are ordered by text). Other columns are left
out, the weight apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

from .common import table, unit_random, word_count

#: The weights of the registered query, repeating over the sources.
WEIGHTS = (5, 2, 1)
MOST, FILLS, BUCKET, SEED = 3, 3, 50_000, 17
LEAST_P, MOST_P = 1e-9, 1 - 1e-9


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source.

    Sources reach their limit in the order of limit / weight, so one running sum over
    them finds where to stop; the table has one row per source, not per document.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("limit", (F.col("source_size") * most).cast("double"))
    by_need = Window.orderBy(F.col("limit") / F.col("w"), "i")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "rate",
        (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("w").over(onward),
    )
    # the first source that its share leaves below its limit sets the rate for all after it
    settled = F.struct((F.col("limit") / F.col("w")).alias("need"), "i", "rate")
    first = F.min(F.when(F.col("rate") * F.col("w") <= F.col("limit"), settled)).over(every)
    share = F.least(first["rate"] * F.col("w"), F.col("limit"))
    return ranked.select("source", "source_size", F.coalesce(share, F.col("limit")).alias("target"))


def _running(rows: DataFrame, size: Column) -> DataFrame:
    """Adds ``up_to``: the sum of ``size`` over the source's rows up to and with each, in rank order."""
    within = Window.partitionBy("s", "bucket").orderBy("rank", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum(size).over(within))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("s", "bucket").agg(F.sum(size).alias("all"))
    offsets = offsets.select("s", "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["s", "bucket"]).withColumn("up_to", F.col("run") + F.col("offset")).drop("run", "offset")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    fills: int = FILLS,
    bucket: int = BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
) -> DataFrame:
    """``doc_id``, ``tie``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words) of every row.

    ``tie`` is the MD5 of the text, which with the id names the row.
    """
    text = F.col(text_col).cast("string")
    odds = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    measured = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        # a name that is never null, to join on
        F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("-")).alias("s"),
        word_count(text).alias("size"),
        F.greatest(odds, F.lit(0.0)).alias("weight"),
        F.md5(F.coalesce(text, F.lit(""))).alias("tie"),
    )
    measured = cut_lineage(measured, "measured")
    sources = measured.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = targets(sources.select("source", "source_size"), weights, most)
    aims = aims.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("s"), "target")
    sources = sources.join(aims, "s")
    sources = sources.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = measured.join(sources.drop("source"), "s")
    # inclusion: in proportion to weight among the documents that fit into the rest
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    shares = rows.where(fits).groupBy("s").agg(F.sum(F.col("weight") * F.col("size")).alias("fitting"))
    rows = rows.join(shares, "s", "left")
    p = F.when(fits & (F.col("fitting") > 0), F.col("rest") * F.col("weight") / F.col("fitting")).otherwise(0.0)
    rows = rows.withColumn("p", F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(MOST_P)))
    u = unit_random(seed, F.col("doc_id"))
    rows = rows.withColumn("open", fits & (F.col("weight") > 0)).withColumn(
        "rank", (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    )
    # even buckets where inclusion is even: the rank times the mean odds is the random odds
    mean = F.least(F.greatest(F.col("rest") / F.greatest("source_size", F.lit(1)), F.lit(LEAST_P)), F.lit(MOST_P))
    even = F.col("rank") * (mean / (1 - mean))
    rows = rows.withColumn("bucket", F.floor(even / (1 + even) * F.ceil(F.col("n") / bucket)))
    rows = cut_lineage(
        rows.select("s", "bucket", "rank", "doc_id", "tie", "source", "size", "source_size", "target", "whole", "rest", "open")
        .withColumn("left", F.col("rest"))
        .withColumn("chosen", F.lit(False)),
        "ranked",
    )
    for _ in range(1 + fills):
        offered = F.when(F.col("open") & ~F.col("chosen") & (F.col("size") <= F.col("left")), F.col("size")).otherwise(0)
        rows = _running(rows.withColumn("offered", offered), F.col("offered"))
        rows = rows.withColumn("now", (F.col("offered") > 0) & (F.col("up_to") <= F.col("left")))
        used = rows.where("now").groupBy("s").agg(F.sum("size").alias("used"))
        rows = rows.join(used, "s", "left").select(
            "s", "bucket", "rank", "doc_id", "tie", "source", "size", "source_size", "target", "whole", "rest", "open",
            (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            (F.col("chosen") | F.col("now")).alias("chosen"),
        )
        rows = cut_lineage(rows, "filled")
    copies = (F.col("whole") + F.col("chosen").cast("int")).cast("long")
    return rows.select(
        "doc_id", "tie", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _fill_sql(before: str, now: str) -> str:
    return f"""
    {now} as (
      select * exclude (offered, up_to, now), l - coalesce(sum(case when now then size end) over (partition by s), 0) l2, chosen or now chosen2
      from (select *, offered > 0 and up_to <= l now
            from (select *, sum(offered) over (partition by s order by rank, doc_id, tie rows unbounded preceding) up_to
                  from (select *, case when open and not chosen and size <= l then size else 0 end offered from {before})))),
    {now}_ as (select * exclude (l, l2, chosen, chosen2), l2 l, chosen2 chosen from {now})"""


def _oracle() -> str:
    fills = ",".join(_fill_sql("f_" if k == 0 else f"f{k - 1}_", f"f{k}") for k in range(1 + FILLS))
    return rf"""
with d as (select doc_id, source, coalesce('+' || source, '-') s, md5(coalesce(text, '')) tie,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents),
ss as (select s, source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 i from d group by 1, 2),
w as (select *, list_extract([{", ".join(f"{w}.0::double" for w in WEIGHTS)}], (i % {len(WEIGHTS)} + 1)::int) w, (source_size * {MOST})::double lim from ss),
r as (select *, ((select sum(source_size) from ss)::double
                 - coalesce(sum(lim) over (order by lim / w, i rows between unbounded preceding and 1 preceding), 0.0))
                / sum(w) over (order by lim / w, i rows between current row and unbounded following) rate from w),
t as (select s, source_size,
             coalesce(least((select rate from r where rate * w <= lim order by lim / w, i limit 1) * w, lim), lim) target from r),
g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole from t),
j as (select d.*, source_size, target, whole, target - whole * source_size rest from d join g using (s)),
p as (select *, size > 0 and size <= rest open, sum(case when size > 0 and size <= rest then 1.0::double * size end) over (partition by s) fitting from j),
q as (select *, least(greatest(case when open and fitting > 0 then rest * 1.0::double / fitting else 0 end, {LEAST_P}), {MOST_P}) pi,
             (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double u from p),
f_ as (select *, (u / (1 - u)) / (pi / (1 - pi)) rank, rest l, false chosen from q),
{fills}
select doc_id, size, source_size, target, (whole + chosen::int) * size taken from f{FILLS}_
"""


ORACLE = _oracle()
