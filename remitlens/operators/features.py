"""Stage 2b: one feature row per labelled claim row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions import claims as fc
from remitlens.schema import AUDIT_COLUMNS, CLAIM_KEY, FEATURES


def collapse_labels(labels: DataFrame) -> DataFrame:
    """One label per key: 1 wins over 0, 0 over unknown. MAX ignores NULL, so it
    is that very order."""
    return labels.groupBy(*CLAIM_KEY).agg(F.max("is_denied").alias("is_denied"))


def drg_lookup(drg: DataFrame, weight_scale: float = 1.0) -> DataFrame:
    """One row per DRG code, so the feature join can never multiply claims."""
    code = fc.present(F.col("drg_code"))
    return (
        drg.select(
            code.alias("drg_code"),
            (fc.first_available(drg, ["weight"], "double", 0.0) * weight_scale).alias("weight"),
            fc.first_available(drg, ["geometric_mean_los", "alos_hist"], "double", 0.0).alias(
                "los"
            ),
        )
        .where("drg_code is not null")
        .groupBy("drg_code")
        .agg(F.max("weight").alias("drg_weight"), F.max("los").alias("drg_los_reference"))
    )


def claim_part(facts: DataFrame) -> DataFrame:
    """What a claim row contributes, computed before it is shuffled."""
    return facts.select(
        *CLAIM_KEY,
        F.col("header_dx_count").alias("icd9_diag_count"),
        F.col("line_dx_count").alias("line_icd9_diag_count"),
        F.size("codes").alias("hcpcs_count"),
        (F.col("header_dx_count") + F.col("line_dx_count")).alias("total_diag_count"),
        fc.claim_month(F.col("CLM_FROM_DT")).alias("claim_month"),
        F.coalesce("days", F.lit(0.0)).alias("utilization_days"),
        fc.present(F.col("CLM_DRG_CD")).alias("drg_code"),
    )


def beneficiary_part(bene: DataFrame) -> DataFrame:
    def number(name: str, cast: str):
        return F.coalesce(F.col(name).try_cast(cast), F.lit(0).cast(cast))

    return bene.select(
        F.col("DESYNPUF_ID"),
        F.col("BENE_BIRTH_DT").alias("birth"),
        number("BENE_HI_CVRAGE_TOT_MONS", "int").alias("bene_hi_coverage_months"),
        number("BENE_SMI_CVRAGE_TOT_MONS", "int").alias("bene_smi_coverage_months"),
        number("MEDREIMB_IP", "double").alias("bene_medreimb_ip"),
        number("MEDREIMB_CAR", "double").alias("bene_medreimb_car"),
        number("BENRES_CAR", "double").alias("bene_benres_car"),
        number("BENE_SEX_IDENT_CD", "int").alias("bene_sex"),
        fc.chronic_count(bene).alias("chronic_condition_count"),
    )


def build_features(
    facts: DataFrame,
    labels: DataFrame,
    drg: DataFrame,
    bene: DataFrame,
    weight_scale: float = 1.0,
) -> DataFrame:
    part = claim_part(facts).where(F.col("sample_id").isNotNull())
    keyed = collapse_labels(labels).select(
        *[F.col(k).alias(f"key_{k}") for k in CLAIM_KEY], "is_denied"
    )
    same = F.col("sample_id") == F.col("key_sample_id")
    for k in CLAIM_KEY:
        if k != "sample_id":
            same = same & F.col(k).eqNullSafe(F.col(f"key_{k}"))
    joined = (
        part.join(keyed, same)
        .drop(*[f"key_{k}" for k in CLAIM_KEY])
        .join(drg_lookup(drg, weight_scale), "drg_code", "left")
        .join(beneficiary_part(bene), "DESYNPUF_ID", "left")
        .withColumn("drg_weight", F.coalesce("drg_weight", F.lit(0.0)))
        .withColumn("drg_los_reference", F.coalesce("drg_los_reference", F.lit(0.0)))
    )
    days, reference = F.col("utilization_days"), F.col("drg_los_reference")
    zero_int = ["bene_hi_coverage_months", "bene_smi_coverage_months", "bene_sex",
                "chronic_condition_count"]
    zero_double = ["bene_medreimb_ip", "bene_medreimb_car", "bene_benres_car"]
    return joined.withColumns(
        {
            "los_outlier_flag": fc.los_outlier(days, reference),
            "short_stay_flag": fc.short_stay(days, reference),
            "bene_age_at_claim": fc.age_at_claim(F.col("birth"), F.col("CLM_FROM_DT")),
            **{c: F.coalesce(c, F.lit(0)) for c in zero_int},
            **{c: F.coalesce(c, F.lit(0.0)) for c in zero_double},
        }
    ).select("CLM_ID", "DESYNPUF_ID", "sample_id", "is_denied", *FEATURES, *AUDIT_COLUMNS)
