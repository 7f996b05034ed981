"""Connected components of a large edge table, by alternating stars.

Each round hooks every node's neighbours to the smallest id around it, first the
larger neighbours, then the smaller ones, until the edges are stars. Only minima
are aggregated, so a node with very many neighbours costs one row per edge and
is split by adaptive execution. Every round is written to the shared folder, so
lost executors never replay the rounds before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component_id`` (smallest id reachable) for the nodes of ``edges``.

    Nodes without edges do not occur; null ends and loops are left out.
    """
    rows = edges.where(F.col(a) != F.col(b))
    rows = cut_lineage(rows.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _fingerprint(rows)
    while True:
        rows = cut_lineage(_small_star(_large_star(rows)), "stars")
        now = _fingerprint(rows)
        if now == seen:
            break
        seen = now
    roots = rows.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return rows.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
