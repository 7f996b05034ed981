"""Uploaded claim tables: checks, serving features, routing and scores."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions import claims as fc
from remitlens.operators import letters as lt
from remitlens.operators import model as ml
from remitlens.schema import FEATURES, HEADER_DX, LINE_DX, PROCEDURES, UPLOAD_REQUIRED

EMPTY_WORDS = ("nan", "None")
BLOCKING = "Missing required CSV columns: "
MAX_SIGNALS = 3

# Risk signals, notes and rejection wording (fixed values).
SIGNAL_SHORT = "short LOS compared with DRG baseline"
SIGNAL_LONG = "LOS outlier for DRG profile"
SIGNAL_CODES = "high HCPCS density"
SIGNAL_BALANCE = "procedure-to-diagnosis imbalance"
SIGNAL_CHRONIC = "extended utilization with limited chronic context"
SIGNAL_DEFAULT = "pattern resembles previously denied cohorts"
NOTE = (
    "Preemptive documentation: include explicit medical necessity statement, diagnosis-to-procedure "
    "linkage, supporting progress notes/labs/imaging, and authorization evidence when applicable."
)
REJECTED = {
    "denial_reason": "Empty row",
    "denial_code": "D-ROW-EMPTY",
    "rationale": "No usable row values found.",
    "preemptive_note": "Populate required claim fields before scoring.",
    "error": "No data in row",
}
MODEL_MISSING = "Stage2 model artifacts unavailable"


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in UPLOAD_REQUIRED if c not in df.columns]


def row_errors(df: DataFrame) -> Column:
    """Blank required cells of a row as texts."""

    def error(name: str) -> Column:
        text = F.concat(F.lit("row "), F.col("row_index").cast("string"), F.lit(f": missing {name}"))
        if name not in df.columns:
            return text
        return F.when(F.coalesce(F.trim(name), F.lit("")) == "", text)

    return F.array_compact(
        F.array(*[error(n) for n in ("claim_id", "drg_code", "primary_diagnosis_code")])
    )


def row_error_rows(df: DataFrame) -> DataFrame:
    """(upload_id, row_index, error): every blank required cell."""
    return df.select("upload_id", "row_index", F.explode(row_errors(df)).alias("error"))


def schema_check(df: DataFrame, listed: int | None = None) -> DataFrame:
    """One row per upload. ``error_count`` counts errors, ``invalid_row_count`` rows;
    ``row_errors`` lists the distinct error texts in order, only the first ``listed`` if
    given; ``row_error_rows`` has all of them, as a table."""
    missing = missing_columns(df)
    checked = df.select("upload_id", row_errors(df).alias("errors"))
    counts = checked.groupBy("upload_id").agg(
        F.count("*").alias("rows_total"),
        F.sum(F.size("errors")).alias("error_count"),
        F.count_if(F.size("errors") > 0).alias("invalid_row_count"),
    )
    distinct = checked.select("upload_id", F.explode("errors").alias("error")).distinct()
    if listed is not None:
        first = Window.partitionBy("upload_id").orderBy("error")
        distinct = distinct.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= listed)
    texts = distinct.groupBy("upload_id").agg(F.array_sort(F.collect_list("error")).alias("row_errors"))
    blocking = BLOCKING + ", ".join(missing) if missing else ""
    return counts.join(texts, "upload_id", "left").select(
        "upload_id",
        "rows_total",
        "error_count",
        "invalid_row_count",
        F.greatest(F.col("rows_total") - F.col("error_count"), F.lit(0)).alias("valid_rows"),
        F.coalesce("row_errors", F.array().cast("array<string>")).alias("row_errors"),
        F.lit(blocking).alias("blocking_errors"),
        F.lit(not missing).alias("is_valid"),
    )


def serving_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus the model's features from free-text upload columns. A column
    that the upload lacks counts as zero."""

    def double(*names: str) -> Column:
        found = next((n for n in names if n in df.columns), None)
        return fc.safe_double(F.col(found)) if found else F.lit(0.0)

    def integer(name: str) -> Column:
        return fc.safe_int(F.col(name)) if name in df.columns else F.lit(0).cast("bigint")

    def text(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit("")

    # what several features are made of is read from its text once
    read = {
        "x_header": fc.count_populated(df, HEADER_DX, EMPTY_WORDS),
        "x_line": fc.count_populated(df, LINE_DX, EMPTY_WORDS),
        "x_days": double("CLM_UTLZTN_DAY_CNT"),
        "x_reference": double("drg_los_reference", "DRG_LOS_REFERENCE"),
    }
    header, line, days, reference = map(F.col, read)
    features = {
        "icd9_diag_count": header,
        "line_icd9_diag_count": line,
        "hcpcs_count": fc.count_populated(df, PROCEDURES, EMPTY_WORDS),
        "total_diag_count": header + line,
        "claim_month": fc.claim_month_serving(text("CLM_FROM_DT")),
        "utilization_days": days,
        "drg_weight": double("drg_weight", "DRG_WEIGHT"),
        "drg_los_reference": reference,
        "los_outlier_flag": fc.los_outlier(days, reference),
        "short_stay_flag": fc.short_stay(days, reference),
        "bene_hi_coverage_months": integer("BENE_HI_CVRAGE_TOT_MONS"),
        "bene_smi_coverage_months": integer("BENE_SMI_CVRAGE_TOT_MONS"),
        "bene_medreimb_ip": double("MEDREIMB_IP"),
        "bene_medreimb_car": double("MEDREIMB_CAR"),
        "bene_benres_car": double("BENRES_CAR"),
        "bene_age_at_claim": fc.age_at_claim_serving(text("BENE_BIRTH_DT"), text("CLM_FROM_DT")),
        "bene_sex": integer("BENE_SEX_IDENT_CD"),
        "chronic_condition_count": fc.chronic_count(df, fc.TRUTHY_SERVING, fold_case=True),
    }
    return df.withColumns(read).select(*keep, *[features[n].alias(n) for n in FEATURES if n not in keep])


def adapt_upload(df: DataFrame) -> DataFrame:
    """Feature inputs under the names uploads use (``length_of_stay_days`` and the
    like), for tables that lack the claim column names."""
    renames = {
        "length_of_stay_days": "CLM_UTLZTN_DAY_CNT",
        "primary_diagnosis_code": "ICD9_DGNS_CD_1",
        "secondary_diagnosis_code": "ICD9_DGNS_CD_2",
        "tertiary_diagnosis_code": "ICD9_DGNS_CD_3",
    }
    added = {
        target: F.col(source)
        for source, target in renames.items()
        if source in df.columns and target not in df.columns
    }
    if "claim_start_date" in df.columns and "CLM_FROM_DT" not in df.columns:
        added["CLM_FROM_DT"] = F.replace("claim_start_date", F.lit("-"), F.lit(""))
    return df.withColumns(added) if added else df


def risk_signals(most: int | None = MAX_SIGNALS) -> Column:
    """The first ``most`` signals that apply, in fixed order (None: all)."""
    codes, dx = F.col("hcpcs_count"), F.col("total_diag_count")
    found = F.array_compact(
        F.array(
            F.when(F.col("short_stay_flag") > 0, SIGNAL_SHORT),
            F.when(F.col("los_outlier_flag") > 0, SIGNAL_LONG),
            F.when(codes >= 3, SIGNAL_CODES),
            F.when((dx <= 1) & (codes >= 2), SIGNAL_BALANCE),
            F.when(
                (F.col("chronic_condition_count") == 0) & (F.col("utilization_days") >= 3),
                SIGNAL_CHRONIC,
            ),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit(SIGNAL_DEFAULT))).otherwise(
        found if most is None else F.slice(found, 1, most)
    )


def preemptive_note(signals: Column) -> Column:
    return F.concat(F.lit(f"{NOTE} Priority focus: "), F.array_join(signals, "; "), F.lit("."))


def reason_from_probability(probability: Column, signals: Column) -> Column:
    """(denial_reason, denial_code, rationale) by probability band.

    The rationale formats are fixed values.
    """
    listed = F.array_join(signals, ", ")

    def band(rule: lt.LetterRule, text: str, with_signals: bool) -> Column:
        args = [probability, listed] if with_signals else [probability]
        return F.struct(
            F.lit(rule.reason).alias("denial_reason"),
            F.lit(rule.code).alias("denial_code"),
            F.format_string(text, *args).alias("rationale"),
        )

    by_code = {rule.code: rule for rule in lt.LETTER_RULES}
    auth, necessity, coverage = (by_code[c] for c in ("D-AUTH-002", "D-MN-003", "D-COVERAGE-004"))
    return (
        F.when(probability >= 0.8, band(necessity, "High denial risk (%.3f) driven by %s.", True))
        .when(
            probability >= 0.6,
            band(coverage, "Moderate-high denial risk (%.3f) with key signals: %s.", True),
        )
        .when(
            probability >= 0.45,
            band(
                auth,
                "Borderline denial risk (%.3f); verify authorization and coding alignment.",
                False,
            ),
        )
        .otherwise(
            band(
                lt.NO_RULE,
                "Lower denial risk (%.3f) but manual validation is still recommended.",
                False,
            )
        )
    )


def stored_threshold(metrics: DataFrame | None) -> Column:
    """Best-F1 threshold of a metrics table, 0.5 without one."""
    if metrics is None or "best_f1_threshold" not in metrics.columns:
        return F.lit(0.5)
    return F.coalesce(metrics.agg(F.max("best_f1_threshold")).scalar(), F.lit(0.5))


def row_text(df: DataFrame, skip: list[str]) -> Column:
    # one small test of an array's cells instead of a branch per column, which made a method too long to be compiled
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns if c not in skip]).cast("array<string>")
    return F.concat_ws(" ", F.filter(cells, lambda c: ~F.trim(c).isin("", *EMPTY_WORDS)))


def route(rows: DataFrame, threshold: Column) -> DataFrame:
    """Result columns per row from ``row_text``, ``signals`` and ``probability``
    (NULL where there is no model): empty rows are rejected, rows without a
    probability are classified by their text, the others scored."""
    empty = F.trim("row_text") == ""
    scored = F.col("probability").isNotNull()
    # each row evaluates only the branch it takes
    by_score = F.when(~empty & scored, reason_from_probability(F.col("probability"), F.col("signals")))
    by_text = F.when(~empty & ~scored, lt.classify(F.col("row_text")))
    staged = rows.withColumns({"s": by_score, "t": by_text})

    def pick(name: str) -> Column:
        return (
            F.when(empty, REJECTED[name]).when(scored, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}"))
        )

    only_scored = ~empty & scored
    return staged.withColumns(
        {
            "status": F.when(empty, "rejected").when(scored, "scored").otherwise("fallback"),
            "inference_mode": F.when(empty, "rejected").when(scored, "model").otherwise("fallback_llm"),
            "denial_probability": F.when(only_scored, F.col("probability")),
            "predicted_denial_flag": F.when(
                only_scored, (F.col("probability") >= threshold).cast("int")
            ),
            "threshold_used": F.when(only_scored, threshold),
            **{n: pick(n) for n in ("denial_reason", "denial_code", "rationale")},
            "preemptive_note": F.when(empty, REJECTED["preemptive_note"]).otherwise(
                preemptive_note(F.col("signals"))
            ),
            "error": F.when(empty, REJECTED["error"]).when(~scored, MODEL_MISSING),
        }
    ).drop("s", "t", "probability", "signals", "row_text")


def score_upload(
    df: DataFrame, model: PipelineModel | None, metrics: DataFrame | None = None
) -> DataFrame:
    """Score every row of a table of uploads in one plan.

    Uploads without the required columns are refused: every row is ``rejected`` with
    the reason in ``error``.
    """
    missing = missing_columns(df)
    texted = with_claim_id(df).withColumn("row_text", row_text(df, skip=["upload_id", "row_index"]))
    ids = ["upload_id", "row_index", "claim_id"]
    features = serving_features(texted, keep=[*ids, "row_text"]).withColumn(
        "signals", risk_signals()
    )
    keep = [*ids, "row_text", "signals"]
    if missing:
        # an empty text is what ``route`` rejects
        ready = features.select(
            *ids, F.lit("").alias("row_text"), "signals", F.lit(None).cast("double").alias("probability")
        )
        refused = route(ready, stored_threshold(metrics))
        return refused.withColumn("error", F.lit(BLOCKING + ", ".join(missing)))
    if model is None:
        ready = features.select(*keep, F.lit(None).cast("double").alias("probability"))
    else:
        ready = ml.score(model, features, keep).withColumnRenamed(ml.PROBABILITY, "probability")
    return route(ready, stored_threshold(metrics))


def with_claim_id(df: DataFrame) -> DataFrame:
    """``claim_id`` from ``CLM_ID`` where the upload has it, else its own, else the row's number."""
    if "CLM_ID" in df.columns:
        return df.withColumn("claim_id", F.col("CLM_ID").cast("string"))
    if "claim_id" in df.columns:
        return df
    return df.withColumn("claim_id", F.concat(F.lit("row-"), F.col("row_index").cast("string")))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("upload_id").agg(
        F.count("*").alias("rows_total"),
        F.count_if(F.col("status") == "scored").alias("rows_scored"),
        F.count_if(F.col("status") == "fallback").alias("rows_fallback"),
        F.count_if(F.col("status") == "rejected").alias("rows_rejected"),
    )


TOP_FIELDS = ["denial_reason", "denial_code", "rationale"]
FIRST_FIELDS = ["denial_source", "drg_code", "carc_code", "caveat_notes"]


def pair_scores(results: DataFrame, uploads: DataFrame) -> DataFrame:
    """Per upload: reason of its most probable row (the first of equals) and the
    context of its first row."""
    context = uploads.select(
        "upload_id", "row_index", claim_row_context_of(uploads), *FIRST_FIELDS
    )
    scores = results.select("upload_id", "row_index", "denial_probability", *TOP_FIELDS)
    paired = scores.join(context, ["upload_id", "row_index"])
    rank = F.struct(F.coalesce("denial_probability", F.lit(0.0)), -F.col("row_index"))
    return (
        paired.groupBy("upload_id")
        .agg(
            F.max_by(F.struct("denial_probability", *TOP_FIELDS), rank).alias("top"),
            F.min_by(F.struct("claim_context", *FIRST_FIELDS), "row_index").alias("first"),
        )
        .select("upload_id", "top.*", "first.*")
    )


def claim_row_context_of(uploads: DataFrame) -> Column:
    return lt.claim_row_context(uploads).alias("claim_context")


LETTER_PREVIEW, POLICY_PREVIEW = 600, 500
CLAIM_FIELDS = [
    "claim_id", "drg_code", "drg_description", "primary_diagnosis_code",
    "primary_diagnosis_description", "secondary_diagnosis_code", "carc_code", "carc_description",
    "rarc_code", "rarc_description", "length_of_stay_days",
]


def session_context(
    results: DataFrame, uploads: DataFrame, packets: DataFrame | None = None
) -> DataFrame:
    """Claim context of a call per upload: fields of its first row, its top score
    and, where an appeal exists, previews of letter and excerpts."""
    fields = [
        (F.col(c) if c in uploads.columns else F.lit("")).alias(c) for c in CLAIM_FIELDS
    ]
    first = uploads.groupBy("upload_id").agg(
        F.min_by(F.struct(*fields), "row_index").alias("claim")
    )
    rank = F.struct(F.coalesce("denial_probability", F.lit(0.0)), -F.col("row_index"))
    top = results.groupBy("upload_id").agg(
        F.max_by(F.struct("denial_probability", *TOP_FIELDS), rank).alias("scoring")
    )
    context = first.join(top, "upload_id", "left")
    if packets is None:
        return context
    appeal = packets.select(
        "upload_id",
        F.struct(
            F.substring("appeal_letter", 1, LETTER_PREVIEW).alias("letter_preview"),
            F.substring("policy_excerpts", 1, POLICY_PREVIEW).alias("policy_excerpts"),
            "context_summary",
        ).alias("appeal"),
    )
    return context.join(appeal, "upload_id", "left")
