"""Column lists, key lists and explicit schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Width of each repeated column group of the wide claims table (fixed values).
HEADER_DX = ("ICD9_DGNS_CD", 10)
LINE_DX = ("LINE_ICD9_DGNS_CD", 13)
PROCEDURES = ("HCPCS_CD", 45)
LINE_STATUS = ("LINE_PRCSG_IND_CD", 13)

CLAIM_KEY = ["CLM_ID", "DESYNPUF_ID", "sample_id", "CLM_FROM_DT", "CLM_THRU_DT", "CLM_DRG_CD"]
AUDIT_COLUMNS = ["CLM_FROM_DT", "CLM_THRU_DT", "CLM_DRG_CD"]

# Chronic-condition flags of the beneficiary table (fixed values).
CHRONIC_FLAGS = [
    "SP_DIABETES",
    "SP_CHF",
    "SP_CNCR",
    "SP_COPD",
    "SP_CHRNKIDN",
    "SP_OSTEOPRS",
    "SP_RA_OA",
    "SP_STRKETIA",
]

FEATURES = [
    "icd9_diag_count",
    "line_icd9_diag_count",
    "hcpcs_count",
    "total_diag_count",
    "claim_month",
    "utilization_days",
    "drg_weight",
    "drg_los_reference",
    "los_outlier_flag",
    "short_stay_flag",
    "bene_hi_coverage_months",
    "bene_smi_coverage_months",
    "bene_medreimb_ip",
    "bene_medreimb_car",
    "bene_benres_car",
    "bene_age_at_claim",
    "bene_sex",
    "chronic_condition_count",
]

# Columns the label was made from: never allowed next to the features (fixed values).
LABEL_SOURCE_COLUMNS = [
    "hcpcs_icd_mismatch",
    "lcd_condition_unmet",
    "unbundling_flag",
    "ptp_conflict",
    "symptom_primary_flag",
    "drg_short_stay_flag",
    "denial_sources",
    "denial_confidence",
    "soft_ptp_risk",
    "soft_mue_frequency_risk",
    "soft_mcd_no_diag_risk",
    "LINE_PRCSG_IND_CD_1",
    "LINE_PRCSG_IND_CD",
    "observed_has_a",
    "observed_has_b",
    "observed_has_c",
]

# Columns an uploaded claim table must have (fixed values).
UPLOAD_REQUIRED = [
    "claim_id",
    "drg_code",
    "drg_description",
    "primary_diagnosis_code",
    "primary_diagnosis_description",
    "carc_code",
    "carc_description",
    "rarc_code",
    "rarc_description",
]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _group(spec: tuple[str, int]) -> list[str]:
    prefix, width = spec
    return [f"{prefix}_{i}" for i in range(1, width + 1)]


CLAIMS_SCHEMA = T.StructType(
    [
        T.StructField("CLM_ID", T.StringType()),
        T.StructField("DESYNPUF_ID", T.StringType()),
        T.StructField("sample_id", T.IntegerType()),
        T.StructField("CLM_FROM_DT", T.StringType()),
        T.StructField("CLM_THRU_DT", T.StringType()),
        T.StructField("CLM_DRG_CD", T.StringType()),
        T.StructField("CLM_UTLZTN_DAY_CNT", T.StringType()),
    ]
    + [
        T.StructField(name, T.StringType())
        for spec in (HEADER_DX, LINE_DX, PROCEDURES, LINE_STATUS)
        for name in _group(spec)
    ]
)

BENEFICIARY_SCHEMA = _strings(
    "DESYNPUF_ID",
    "BENE_BIRTH_DT",
    "BENE_SEX_IDENT_CD",
    "BENE_HI_CVRAGE_TOT_MONS",
    "BENE_SMI_CVRAGE_TOT_MONS",
    "MEDREIMB_IP",
    "MEDREIMB_CAR",
    "BENRES_CAR",
    *CHRONIC_FLAGS,
)

MUE_FILE_SCHEMA = _strings("hcpcs_code", "mue_value", "adjudication_indicator", "rationale")
PTP_FILE_SCHEMA = _strings(
    "code1", "code2", "unused", "effective_date", "deletion_date", "modifier", "rationale"
)
ARTICLE_HCPCS_SCHEMA = _strings("article_id", "hcpcs_code")
ARTICLE_ICD10_SCHEMA = _strings("article_id", "icd10_code")
NCD_SCHEMA = _strings(
    "NCD_id", "NCD_vrsn_num", "NCD_mnl_sect_title", "ncd_keyword", "itm_srvc_desc",
    "indctn_lmtn", "xref_txt", "othr_txt", "rev_hstry",
)
ARTICLE_SCHEMA = _strings(
    "article_id", "article_version", "title", "keywords", "description", "other_comments",
    "cms_cov_policy",
)
MANIFEST_SCHEMA = _strings(
    "source", "source_id", "version", "title", "chunk_number", "chunk_total", "file_path"
)

_CLAIM_DETAIL = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("beneficiary_id", T.StringType()),
        T.StructField("date_of_service", T.StringType()),
        T.StructField("date_thru", T.StringType()),
        T.StructField("drg_code", T.StringType()),
        T.StructField("drg_description", T.StringType()),
        T.StructField("diagnoses", T.MapType(T.StringType(), T.StringType())),
        T.StructField("length_of_stay_days", T.LongType()),
        T.StructField("claim_payment_amount", T.DoubleType()),
        T.StructField("denial_reason", T.StringType()),
    ]
)
SCENARIO_SCHEMA = T.StructType(
    [
        T.StructField("provider", T.MapType(T.StringType(), T.StringType())),
        T.StructField("claim", _CLAIM_DETAIL),
        T.StructField("classifier", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ivr_status", T.MapType(T.StringType(), T.StringType())),
        T.StructField("call_reference_number", T.StringType()),
        T.StructField("prior_call_reference", T.StringType()),
        T.StructField(
            "appeal",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("submission_method", T.StringType()),
                    T.StructField("carc_code", T.StringType()),
                    T.StructField("rarc_code", T.StringType()),
                    T.StructField("clinical_justification", T.StringType()),
                    T.StructField("supporting_docs", T.ArrayType(T.StringType())),
                    T.StructField("appeal_tracking_number", T.StringType()),
                    T.StructField("review_timeline_days", T.LongType()),
                    T.StructField("determination_method", T.StringType()),
                    T.StructField("filing_deadline_days", T.LongType()),
                ]
            ),
        ),
        T.StructField("caveat", T.StringType()),
    ]
)
CLAIM_CONTEXT_SCHEMA = T.StructType(
    [T.StructField("scenario_2", SCENARIO_SCHEMA), T.StructField("scenario_3", SCENARIO_SCHEMA)]
)
DENIAL_CASE_SCHEMA = _strings(
    "id", "denial_type", "denial_reason", "denial_code", "ground_truth_appeal"
)
