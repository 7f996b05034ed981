"""Chat rendering of the maximal conversations of a log.

A log often holds each state of a conversation as a conversation of its own.
Every turn hashes its place, role and text; the running XOR of these hashes names
each prefix (two hashes of 64 bits and the number of turns). A conversation whose
whole name is a shorter prefix of another one is dropped by an anti join; among
equal ones the smallest id stays. Turns are dealt in blocks of their numbers, so
a conversation that holds much of the log is not one task's work.

Turns go by turn number, role and text (nulls last); gaps do not matter, rows
that repeat are turns of their own. A null role or text equals only a null, and is
rendered empty. Rows with a null conversation id belong to no conversation and are
left out. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 512


def _content() -> Column:
    def shown(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit("-")).otherwise(
            F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), F.col(c))
        )

    return F.concat(shown("role"), shown("text"))


def numbered(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns with their place ``idx`` (from 1), the conversation's ``n`` and the name of the prefix they end."""
    rows = (
        turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
        .where(F.col("conv_id").isNotNull())
        # turns without a number follow in a block of their own
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit((1 << 63) - 1)))
    )
    order = [F.asc_nulls_last(c) for c in ("turn", "role", "text")]
    within = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = rows.withColumn("k", F.row_number().over(within))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.sum("size").over(Window.partitionBy("conv_id")).alias("n"),
    )
    rows = rows.join(blocks, ["conv_id", "block"]).withColumn("idx", F.col("offset") + F.col("k"))
    rows = rows.withColumn("h1", F.xxhash64("idx", _content())).withColumn("h2", F.xxhash64(_content(), "idx", F.lit(1)))
    totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    totals = totals.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("o1"),
        F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("o2"),
    )
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(totals, ["conv_id", "block"]).select(
        "conv_id", "idx", "n", "role", "text",
        F.bit_xor("h1").over(running).bitwiseXOR(F.col("o1")).alias("p1"),
        F.bit_xor("h2").over(running).bitwiseXOR(F.col("o2")).alias("p2"),
    )


def maximal(named: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_copies`` of the conversations that no longer one continues."""
    whole = named.where(F.col("idx") == F.col("n")).select("conv_id", "n", "p1", "p2")
    whole = whole.groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    parts = named.where(F.col("idx") < F.col("n")).select(F.col("idx").alias("n"), "p1", "p2").distinct()
    return whole.join(parts, ["n", "p1", "p2"], "left_anti").select("conv_id", "n_copies")


def render(named: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rendered text of the kept conversations, in parts of ``block`` turns each."""
    turn = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")
    )
    return (
        named.join(kept, "conv_id")
        .groupBy("conv_id", F.floor((F.col("idx") - 1) / block).alias("part"))
        .agg(
            F.max("n").alias("n_turns"),
            F.max("n_copies").alias("n_copies"),
            F.array_sort(F.collect_list(F.struct("idx", turn.alias("said")))).alias("turns"),
        )
        .select("conv_id", "part", "n_turns", "n_copies", F.array_join("turns.said", "").alias("rendered"))
    )


def collapse(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    named = numbered(turns, block)
    return render(named, maximal(named), block)


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE = f"""
with t as (
  select conv_id, role, text,
         case when role is null then '-' else '+' || length(role) || ':' || role end ||
         case when text is null then '-' else '+' || length(text) || ':' || text end k,
         row_number() over (partition by conv_id order by turn nulls last, role nulls last, text nulls last) idx,
         count(*) over (partition by conv_id) n
  from conversations where conv_id is not null),
p as (select *, string_agg(k, '') over (partition by conv_id order by idx rows unbounded preceding) s from t),
w as (select n, s, min(conv_id) conv_id, count(*) n_copies from p where idx = n group by 1, 2),
m as (select conv_id, n_copies from w where not exists (select 1 from p where p.idx < p.n and p.idx = w.n and p.s = w.s))
select conv_id, (idx - 1) // {BLOCK} part, n n_turns, n_copies,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' order by idx) rendered
from t join m using (conv_id) group by all
"""
