"""Claim-side tables: wide claims and beneficiaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.schema import BENEFICIARY_SCHEMA, CLAIM_KEY


def select_claims(
    claims: DataFrame, sample_id: int | None = None, max_claims: int | None = None
) -> DataFrame:
    """One sample of a claims table; a row cap is taken in key order."""
    if sample_id is not None:
        claims = claims.where(F.col("sample_id") == sample_id)
    if max_claims:
        claims = claims.orderBy(*CLAIM_KEY).limit(max_claims)
    return claims


def scan_claims(
    spark: SparkSession, path: str, sample_id: int | None = None, max_claims: int | None = None
) -> DataFrame:
    return select_claims(spark.read.parquet(path), sample_id, max_claims)


def scan_beneficiaries(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV. Columns are matched by name: the file may order them freely."""
    header = spark.read.option("header", True).option("enforceSchema", False)
    raw = header.csv(path)
    have = set(raw.columns)
    return raw.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in BENEFICIARY_SCHEMA
        ]
    )
