"""Summary tables and the text report. All results are a handful of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


DENY = "HARD_DENY"
PASS = "PASS_TO_ML"


def rule_summary(stage1: DataFrame) -> DataFrame:
    return (
        stage1.groupBy("stage1_reason_code", "stage1_decision")
        .agg(F.count("*").alias("claim_count"))
        .orderBy(F.desc("claim_count"), "stage1_reason_code")
    )


def stage1_totals(stage1: DataFrame) -> DataFrame:
    return stage1.agg(
        F.count("*").alias("total_claims"),
        F.count_if(F.col("stage1_decision") == DENY).alias("hard_deny_claims"),
        F.count_if(F.col("stage1_decision") == PASS).alias("pass_to_ml_claims"),
        F.count_if("observed_has_b").alias("observed_b_claims"),
        F.count_if("observed_has_c").alias("observed_c_claims"),
    )


def stage1_validation(stage1: DataFrame) -> DataFrame:
    return (
        stage1.groupBy("stage1_reason_code", "stage1_decision")
        .agg(
            F.count("*").alias("claim_count"),
            _rate(F.col("observed_has_b")).alias("pct_observed_b"),
            _rate(F.col("observed_has_c")).alias("pct_observed_c"),
        )
        .orderBy(F.desc("claim_count"), "stage1_reason_code")
    )


def guardrail_overlap(stage1: DataFrame) -> DataFrame:
    deny = F.col("stage1_decision") == DENY
    b, c = F.col("observed_has_b"), F.col("observed_has_c")
    counted = stage1.agg(
        F.count("*").alias("total_claims"),
        F.count_if(deny).alias("hard_deny_claims"),
        F.count_if(F.col("stage1_decision") == PASS).alias("pass_to_ml_claims"),
        F.count_if(b).alias("observed_b_claims"),
        F.count_if(c).alias("observed_c_claims"),
        F.count_if(deny & b).alias("hard_deny_with_b"),
        F.count_if(deny & c).alias("hard_deny_with_c"),
        F.count_if(deny & ~b & ~c).alias("hard_deny_without_bc"),
    )
    return counted.withColumns(
        {
            "hard_deny_rate": F.coalesce(
                F.try_divide("hard_deny_claims", "total_claims"), F.lit(0.0)
            ),
            "pass_rate": F.coalesce(
                F.try_divide("pass_to_ml_claims", "total_claims"), F.lit(0.0)
            ),
        }
    )


def label_summary(labels: DataFrame) -> DataFrame:
    return (
        labels.where(F.col("is_denied").isNotNull())
        .groupBy("is_denied", "denial_sources")
        .agg(F.count("*").alias("claim_count"))
        .orderBy(F.desc("claim_count"), "is_denied", "denial_sources")
    )


def label_totals(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("is_denied") == 1).alias("denied_rows"),
        F.count_if(F.col("is_denied") == 0).alias("approved_rows"),
        F.count_if(F.col("is_denied").isNull()).alias("unlabeled_rows"),
    )


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("is_denied") == 1).alias("denied_rows"),
        F.count_if(F.col("is_denied") == 0).alias("approved_rows"),
        F.avg("icd9_diag_count").alias("avg_icd9_diag_count"),
        F.avg("hcpcs_count").alias("avg_hcpcs_count"),
        F.avg("chronic_condition_count").alias("avg_chronic_conditions"),
        F.avg("drg_weight").alias("avg_drg_weight"),
    )


def denial_source_top(labels: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent source sets of positive labels, with their share of the
    listed rows and of all positives (a claim has at most five sources, so the
    grouped table has at most 32 rows)."""
    counts = (
        labels.where(F.col("is_denied") == 1)
        .groupBy("denial_sources")
        .agg(F.count("*").alias("claim_count"))
    )
    total = counts.agg(F.sum("claim_count")).scalar()
    top = (
        counts.withColumn("all_count", total)
        .orderBy(F.desc("claim_count"), "denial_sources")
        .limit(k)
    )
    listed = top.agg(F.sum("claim_count")).scalar()
    return top.select(
        "denial_sources",
        "claim_count",
        (100.0 * F.col("claim_count") / listed).alias("share_of_top"),
        (100.0 * F.col("claim_count") / F.col("all_count")).alias("share_of_all"),
    ).orderBy(F.desc("claim_count"), "denial_sources")


def _lines(df: DataFrame, section: int, order: list, text: Column) -> DataFrame:
    """Number the (few) rows of a summary table as report lines of a section."""
    rows = df.agg(
        F.array_sort(F.collect_list(F.struct(*order, text.alias("text")))).alias("rows")
    )
    return rows.select(F.posexplode("rows").alias("line", "row")).select(
        F.lit(section).alias("section"), "line", F.col("row.text").alias("text")
    )


def _fixed(df: DataFrame, section: int, rows: list[Column]) -> DataFrame:
    return df.select(F.posexplode(F.array(*rows)).alias("line", "text")).select(
        F.lit(section).alias("section"), "line", "text"
    )


def markdown_report(
    stage1: DataFrame,
    metrics: DataFrame,
    operating: DataFrame,
    labels: DataFrame,
    sample_id: int,
) -> DataFrame:
    """The report as (section, line, text) rows; order by both and write as text.

    The headings, line texts and notes below are fixed values of the report.
    """

    def n(name: str) -> Column:
        return F.format_number(F.col(name), 0)

    def pct(name: str) -> Column:
        return F.format_string("%.2f%%", F.col(name) * 100)

    def f4(name: str) -> Column:
        return F.format_string("%.4f", F.col(name).cast("double"))

    first = _fixed(
        guardrail_overlap(stage1),
        1,
        [
            F.lit(f"# Sample {sample_id:02d} Performance Report"),
            F.lit(""),
            F.lit("## Stage 1 (Deterministic Rules)"),
            F.lit(""),
            F.concat(F.lit("- Total claims: "), n("total_claims")),
            F.concat(
                F.lit("- Hard deny: "), n("hard_deny_claims"), F.lit(" ("),
                pct("hard_deny_rate"), F.lit(")"),
            ),
            F.concat(
                F.lit("- Pass to ML: "), n("pass_to_ml_claims"), F.lit(" ("),
                pct("pass_rate"), F.lit(")"),
            ),
            F.concat(F.lit("- Observed B (guardrail): "), n("observed_b_claims")),
            F.concat(F.lit("- Observed C (guardrail): "), n("observed_c_claims")),
            F.concat(F.lit("- Hard deny ∩ observed B: "), n("hard_deny_with_b")),
            F.concat(F.lit("- Hard deny ∩ observed C: "), n("hard_deny_with_c")),
            F.concat(
                F.lit("- Hard deny without B/C (potential contradiction bucket): "),
                n("hard_deny_without_bc"),
            ),
        ],
    )
    second = _fixed(
        metrics,
        2,
        [
            F.lit(""),
            F.lit("## Stage 2 (Boosted trees)"),
            F.lit("### Primary Metrics"),
            F.lit(""),
            F.concat(F.lit("- Rows total: "), n("rows_total")),
            F.concat(F.lit("- Positive rate: "), f4("positive_rate")),
            F.concat(F.lit("- PR-AUC: "), f4("pr_auc")),
            F.lit(""),
            F.lit("### Best Threshold Performance (Patient-level split)"),
            F.lit(""),
            F.concat(F.lit("- Best F1 threshold: "), f4("best_f1_threshold")),
            F.concat(F.lit("- F1 @ best threshold: "), f4("best_f1")),
            F.concat(F.lit("- Precision @ best threshold: "), f4("best_precision")),
            F.concat(F.lit("- Recall @ best threshold: "), f4("best_recall")),
            F.lit(""),
            F.lit("### High-Precision Operating Point"),
            F.lit(""),
            F.concat(
                F.lit("- Recall @ Precision>=0.80: "), f4("recall_at_precision_080")
            ),
            F.lit(""),
            F.lit("### PR Operating Table"),
            F.lit(""),
            F.lit("| Threshold | Precision | Recall | F1 |"),
            F.lit("|-----------|-----------|--------|----|"),
        ],
    )
    table = _lines(
        operating,
        3,
        ["point"],
        F.concat(
            F.lit("| "), f4("threshold"), F.lit(" | "), f4("precision"), F.lit(" | "),
            f4("recall"), F.lit(" | "), f4("f1"), F.lit(" |"),
        ),
    )
    sources = _lines(
        denial_source_top(labels).withColumn("rank_key", -F.col("claim_count")),
        5,
        ["rank_key", "denial_sources"],
        F.concat(
            F.lit("| "),
            F.when(F.col("denial_sources") == "", "none").otherwise(F.col("denial_sources")),
            F.lit(" | "), n("claim_count"), F.lit(" | "),
            F.format_string("%.2f%%", F.col("share_of_top")), F.lit(" |"),
        ),
    )
    # the source table has a heading only where a claim is labelled as denied
    denied = labels.agg(F.count_if(F.col("is_denied") == 1).alias("denied")).where("denied > 0")
    source_head = _fixed(
        denied,
        4,
        [
            F.lit(""),
            F.lit("### Denial Source Breakdown (Test Set Positives)"),
            F.lit(""),
            F.lit("| Source(s) | Count | Percentage |"),
            F.lit("|-----------|-------|------------|"),
        ],
    )
    notes = _fixed(
        guardrail_overlap(stage1),
        6,
        [
            F.lit(""),
            F.lit("## Notes"),
            F.lit(""),
            F.lit("- Stage 1 B/C values are used for calibration only and excluded from Stage 2 target labels."),
            F.lit("- MUE is treated as a soft feature in SynPUF context (no service unit fields)."),
            F.concat(F.lit("- Current contradiction bucket size: "), n("hard_deny_without_bc"), F.lit(" claims.")),
            F.lit("- Patient-level split prevents same beneficiary appearing in both train and test sets."),
            F.lit("- Best threshold optimized for F1 score on test set; may differ from fixed 0.50 threshold."),
        ],
    )
    parts = [first, second, table, source_head, sources, notes]
    return reduce(DataFrame.unionByName, parts)
