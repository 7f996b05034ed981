"""Places of rows in an order, without a task that sees a whole key.

Rows are dealt into ranges of the order and sorted there; a stored table keeps the
range and the place in it. What lies before a range, of a key or of everything, is a
running sum over one row per range (and key), so a key that holds most of the rows
costs as little as a small one. Equal rows are told apart by where they were read, so
many copies of a row spread over ranges too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

#: Bits of ``monotonically_increasing_id`` below the number of the partition.
ROW_BITS = 33


def ranged(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows``, stored by ``order``, with their range ``part`` and their place ``row`` in it.

    ``rows`` are read twice (once for the bounds of the ranges), so they should come
    from a stored table.
    """
    rows = rows.withColumn("read_at", F.monotonically_increasing_id())
    by = [*order, F.col("read_at")]
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", at)
    dealt = dealt.withColumn("part", F.shiftright("at", ROW_BITS)).withColumn(
        "row", F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    )
    return cut_lineage(dealt.drop("read_at", "at"), name)


def places(rows: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order`` within ``key``) and ``n`` (rows of the key); null is a key."""
    stored = ranged(rows, [F.asc_nulls_first(key), *order], name)
    runs = stored.groupBy("part", key).agg(F.min("row").alias("first_row"), F.count("*").alias("held"))
    by_key = Window.partitionBy(key)
    before = by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("run_part"),
        F.col(key).alias("run_key"),
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first_row")).alias("shift"),
        F.sum("held").over(by_key).alias("n"),
    )
    same = (F.col("part") == F.col("run_part")) & F.col(key).eqNullSafe(F.col("run_key"))
    return stored.join(runs, same).withColumn("pos", F.col("row") + F.col("shift")).drop(
        "run_part", "run_key", "shift", "part", "row"
    )


def totals_before(rows: DataFrame, at: str, *sums: str) -> DataFrame:
    """``at`` and, per column of ``sums``, its total over all rows with a smaller ``at``, as ``before_<column>``.

    For tables of one row per range or shard, which one task orders.
    """
    totals = rows.groupBy(at).agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(at, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums])
