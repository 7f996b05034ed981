"""Stage 2a: weak labels from weighted triggers over the pass-through claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions import claims as fc
from remitlens.operators import rules
from remitlens.schema import CLAIM_KEY

PAIR_WEIGHT, PAIR_SOURCE = 0.6, "ptp_conflict"
REPEAT_WEIGHT, REPEAT_SOURCE = 0.5, "mue_frequency"
NO_DX_WEIGHT, NO_DX_SOURCE = 0.7, "lcd_no_diagnosis"
SHORT_STAY_WEIGHT, SHORT_STAY_SOURCE = 0.85, "drg_shortstay_upcoding"
SYMPTOM_SOURCE = "symptom_primary_definitive_proc"


def gate_pass_through(facts: DataFrame, stage1: DataFrame) -> DataFrame:
    """Claim rows of a known sample that Stage 1 lets pass.

    A verdict belongs to a claim id, so the gate is an anti join with the distinct
    convicted ids; rows without an id are never convicted.
    """
    convicted = stage1.where(F.col("stage1_decision") == "HARD_DENY").select("CLM_ID").distinct()
    return facts.where(F.col("sample_id").isNotNull()).join(convicted, "CLM_ID", "left_anti")


def _trigger(hit: DataFrame, weight: float, source: str) -> DataFrame:
    return hit.select(
        "CLM_ID", F.lit(weight).alias("weight"), F.lit(source).alias("source_name")
    )


def soft_pair_risk(facts: DataFrame, ptp: DataFrame) -> DataFrame:
    pairs = rules.canonical_pairs(ptp, with_modifier=False)
    return _trigger(rules.listed_pair_claims(facts, pairs), PAIR_WEIGHT, PAIR_SOURCE)


def soft_repeat_risk(facts: DataFrame) -> DataFrame:
    """A code billed more than once on a claim: one row per repeated code."""
    repeated = (
        rules.claim_codes(facts).groupBy("CLM_ID", "hcpcs_code").count().where("count > 1")
    )
    return _trigger(repeated, REPEAT_WEIGHT, REPEAT_SOURCE)


def soft_no_diagnosis_risk(facts: DataFrame, links: DataFrame) -> DataFrame:
    return _trigger(rules.undiagnosed_linked_claims(facts, links), NO_DX_WEIGHT, NO_DX_SOURCE)


def soft_short_stay_risk(facts: DataFrame, drg: DataFrame) -> DataFrame:
    """Stay shorter than half the DRG's days; the reference falls back from the
    historical stay to the weight."""
    reference = fc.first_available(drg, ["alos_hist", "weight"], "double", 0.0)
    stays = (
        drg.select(fc.present(F.col("drg_code")).alias("drg"), reference.alias("ref_days"))
        .where("drg is not null and ref_days > 0")
        .groupBy("drg")
        .agg(F.max("ref_days").alias("ref_days"))
    )
    used = facts.where("CLM_ID is not null and days >= 1").select(
        "CLM_ID", fc.present(F.col("CLM_DRG_CD")).alias("drg"), "days"
    )
    short = used.join(stays, "drg").where("days < 0.5 * ref_days").select("CLM_ID").distinct()
    return _trigger(short, SHORT_STAY_WEIGHT, SHORT_STAY_SOURCE)


def soft_symptom_risk(
    facts: DataFrame,
    weights: list[tuple[str, float]] | None = None,
    strip_dots: bool = False,
) -> DataFrame:
    """Symptom-only first line diagnosis together with a definitive procedure."""
    listed = F.array(
        *[
            F.struct(F.lit(c).cast("string").alias("hcpcs_code"), F.lit(w).cast("double").alias("weight"))
            for c, w in weights or fc.procedure_weights()
        ]
    )
    # rows made from literals are known to be few, so codes meet them where they lie
    table = facts.sparkSession.range(1).select(F.inline(listed))
    symptomatic = (
        facts.where(F.col("CLM_ID").isNotNull())
        .where(fc.symptom_primary(F.col("first_line_dx"), strip_dots=strip_dots))
        .select("CLM_ID")
        .distinct()
    )
    return (
        rules.claim_codes(facts)
        .join(table, "hcpcs_code")
        .groupBy("CLM_ID")
        .agg(F.max("weight").alias("weight"))
        .join(symptomatic, "CLM_ID", "left_semi")
        .withColumn("source_name", F.lit(SYMPTOM_SOURCE))
    )


def all_triggers(
    facts: DataFrame,
    ptp: DataFrame,
    links: DataFrame,
    drg: DataFrame,
    strip_dots: bool = False,
) -> DataFrame:
    parts = [
        soft_pair_risk(facts, ptp),
        soft_repeat_risk(facts),
        soft_no_diagnosis_risk(facts, links),
        soft_short_stay_risk(facts, drg),
        soft_symptom_risk(facts, strip_dots=strip_dots),
    ]
    return reduce(DataFrame.unionByName, parts)


def claim_risk_summary(triggers: DataFrame) -> DataFrame:
    """Strongest weight and the sorted set of sources (at most five) per claim."""
    return triggers.groupBy("CLM_ID").agg(
        F.max("weight").alias("denial_confidence"),
        F.array_join(F.sort_array(F.collect_set("source_name")), "|").alias("denial_sources"),
    )


def label(observed_a, observed_bc, triggered):
    """1, 0 or NULL: an observed B/C hides the row, then a trigger, then an A."""
    return F.when(observed_bc, F.lit(None).cast("int")).when(triggered, 1).when(observed_a, 0)


def train_labels(facts: DataFrame, summary: DataFrame) -> DataFrame:
    joined = facts.select(*CLAIM_KEY, "seen_a", "seen_b", "seen_c").join(summary, "CLM_ID", "left")
    return joined.select(
        *CLAIM_KEY,
        F.coalesce("denial_confidence", F.lit(0.0)).alias("denial_confidence"),
        F.coalesce("denial_sources", F.lit("")).alias("denial_sources"),
        label(
            F.col("seen_a"),
            F.col("seen_b") | F.col("seen_c"),
            F.col("denial_confidence").isNotNull(),
        ).alias("is_denied"),
    )
