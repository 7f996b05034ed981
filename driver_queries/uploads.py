"""Uploaded claim tables made from orders: checks, features, routing, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import files as fl
from driver_queries import model as md
from driver_queries import prepared as pt
from remitlens.operators import letters as lt
from remitlens.operators import uploads as up
from remitlens.schema import FEATURES

IDS = ["upload_id", "row_index", "claim_id"]


def rows(spark, d):
    return fl.upload_rows(spark, d)


def featured(spark, d):
    return up.serving_features(rows(spark, d), IDS).withColumn("signals", up.risk_signals())


def _probability():
    return ((F.col("row_index") % 101) / 100.0).alias("probability")


def _check(spark, d):
    return up.schema_check(rows(spark, d)).withColumn(
        "row_errors", F.array_join("row_errors", ";")
    )


def _signals(spark, d):
    return featured(spark, d).select("row_index", F.array_join("signals", "|").alias("signals"))


def _reason(spark, d):
    banded = featured(spark, d).select("row_index", "signals", _probability())
    return banded.select(
        "row_index",
        up.reason_from_probability(F.col("probability"), F.col("signals")).alias("r"),
    ).select("row_index", "r.*")


def _note(spark, d):
    return featured(spark, d).select("row_index", up.preemptive_note(F.col("signals")).alias("note"))


def _flag(spark, d):
    """Threshold from the metrics of the scored line items."""
    from remitlens.operators import evaluate as ev

    metrics = ev.best_f1(md.curve(spark, d))
    base = rows(spark, d).select("row_index", _probability())
    return base.select(
        "row_index",
        (F.col("probability") >= up.stored_threshold(metrics)).cast("int").alias("flag"),
        (F.col("probability") >= up.stored_threshold(None)).cast("int").alias("flag_default"),
    )


def routed(spark, d):
    """Upload 3 has no model; the others get a probability from their row number."""
    table = rows(spark, d)
    texted = table.withColumn("row_text", up.row_text(table, ["upload_id", "row_index"]))
    ready = up.serving_features(texted, [*IDS, "row_text"]).select(
        *IDS, "row_text", up.risk_signals().alias("signals"),
        F.when(F.col("upload_id") != 3, F.col("row_index") % 101 / 100.0).alias("probability"),
    )
    return up.route(ready, up.stored_threshold(None))


def _pairing(spark, d):
    p = up.pair_scores(routed(spark, d), rows(spark, d))
    return p.select("upload_id", "denial_probability", "denial_code", "claim_context",
                    "denial_source", "drg_code", "carc_code", "caveat_notes")


def _session(spark, d):
    c = up.session_context(routed(spark, d), rows(spark, d))
    return c.select(
        "upload_id", F.col("claim.claim_id").alias("claim_id"), F.col("claim.carc_code").alias("carc_code"),
        F.col("scoring.denial_probability").alias("probability"),
        F.col("scoring.denial_code").alias("denial_code"),
    )


def _row_context(spark, d):
    table = rows(spark, d)
    return table.select("row_index", lt.claim_row_context(table).alias("context"))


def _scored(spark, d):
    """Scored by the one-tree model, whose probabilities are known."""
    scored = up.score_upload(rows(spark, d), md.rule_model(spark, d)).drop("preemptive_note")
    return scored.withColumn("denial_probability", F.round("denial_probability", 6))


def _refused(spark, d):
    """An upload without two required columns: no row is scored, all are counted as rejected."""
    return up.status_counts(up.score_upload(rows(spark, d).drop("claim_id", "drg_code"), md.model(spark, d)))


QUERIES = {
    "feature_row_serving": lambda s, d: featured(s, d).drop("signals", "upload_id", "claim_id"),
    "upload_schema_check": _check,
    "upload_row_errors": lambda s, d: up.row_error_rows(rows(s, d)),
    "upload_refused": _refused,
    "risk_signals": _signals,
    "reason_from_probability": _reason,
    "preemptive_note": _note,
    "threshold_flag": _flag,
    "row_routing": lambda s, d: routed(s, d).drop("preemptive_note"),
    "status_counts": lambda s, d: up.status_counts(routed(s, d)),
    "score_claim_pairing": _pairing,
    "context_from_scores": _session,
    "claim_row_context": _row_context,
    "score_upload": _scored,
}

_BASE = """with u as (select o_orderkey k, o_orderkey%8 upload_id, o_orderkey%97=0 blank, o_orderpriority pri, o_orderstatus st, o_totalprice price,
   o_orderdate from orders),
r as (select *, case when blank or k%10=0 then '' else cast(k as varchar) end claim_id,
   case when blank then '' when k%15=0 then ' ' else cast(200+k%25 as varchar) end drg_code,
   case when blank then '' else 'DRG group ' || k%25 end drg_description,
   case when blank or pri='4-NOT SPECIFIED' then '' else '25000' end dx_code, case when blank then '' else pri end dx_text,
   case when blank then '' when st='F' then 'CO-4' else 'CO-50' end carc_code,
   case when blank then '' when k%12=0 then 'may be a false-positive' else 'none' end caveat_notes,
   case when blank then '' when k%2=0 then 'drg_shortstay_upcoding' else '' end denial_source,
   case when blank then '' else 'N386' end rarc_code,
   case when blank then 0 else k%15 end::double as days, case when blank then 0 else 3+k%9 end::double ref,
   case when not blank and k%4=0 then 1 else 0 end dx,
   case when blank then 0 else (case when k%3<>0 then 1 else 0 end)+(case when k%2=0 then 1 else 0 end)+(case when k%5=0 then 1 else 0 end) end codes,
   case when not blank and k%6=0 then 1 else 0 end chronic from u),
f as (select *, case when ref>0 and days>1.5*ref then 1 else 0 end out_flag, case when ref>0 and days<0.5*ref then 1 else 0 end short_flag from r),
s0 as (select *, list_filter([case when short_flag=1 then 'short LOS compared with DRG baseline' end,
   case when out_flag=1 then 'LOS outlier for DRG profile' end, case when codes>=3 then 'high HCPCS density' end,
   case when dx<=1 and codes>=2 then 'procedure-to-diagnosis imbalance' end,
   case when chronic=0 and days>=3 then 'extended utilization with limited chronic context' end], lambda x: x is not null) found from f),
s as (select *, case when len(found)=0 then ['pattern resembles previously denied cohorts'] else found[1:3] end signals,
   (k%101)/100.0::double p from s0),
b as (select *, case when p>=0.8 then 'D-MN-003' when p>=0.6 then 'D-COVERAGE-004' when p>=0.45 then 'D-AUTH-002' else 'D-REVIEW-000' end denial_code,
   case when p>=0.8 then 'Medical necessity documentation insufficient' when p>=0.6 then 'Non-covered service or coding mismatch'
     when p>=0.45 then 'Missing prior authorization' else 'Insufficient claim evidence - manual review needed' end denial_reason,
   case when p>=0.8 then printf('High denial risk (%.3f) driven by %s.', p, array_to_string(signals, ', '))
     when p>=0.6 then printf('Moderate-high denial risk (%.3f) with key signals: %s.', p, array_to_string(signals, ', '))
     when p>=0.45 then printf('Borderline denial risk (%.3f); verify authorization and coding alignment.', p)
     else printf('Lower denial risk (%.3f) but manual validation is still recommended.', p) end rationale from s),
ro as (select k row_index, upload_id, claim_id, case when blank then 'rejected' when upload_id=3 then 'fallback' else 'scored' end status,
   case when blank then 'rejected' when upload_id=3 then 'fallback_llm' else 'model' end inference_mode,
   case when not blank and upload_id<>3 then p end denial_probability,
   case when not blank and upload_id<>3 then (p>=0.5)::int end predicted_denial_flag,
   case when not blank and upload_id<>3 then 0.5::double end threshold_used,
   case when blank then 'Empty row' when upload_id<>3 then denial_reason when st<>'F' then 'Medical necessity documentation insufficient'
     else 'Non-covered service or coding mismatch' end denial_reason,
   case when blank then 'D-ROW-EMPTY' when upload_id<>3 then denial_code when st<>'F' then 'D-MN-003' else 'D-COVERAGE-004' end denial_code,
   case when blank then 'No usable row values found.' when upload_id<>3 then rationale
     when st<>'F' then 'Coverage language suggests documentation did not meet LCD/NCD requirements.'
     else 'Denial appears to involve non-covered service definitions or coding mismatches.' end rationale,
   case when blank then 'No data in row' when upload_id=3 then 'Stage2 model artifacts unavailable' end error,
   'Claim ID: ' || claim_id || ' | DRG: ' || drg_code || ' (' || drg_description || ') | Primary Dx: ' || dx_code || ' ' || dx_text
     || ' | Secondary Dx:   | Tertiary Dx:   | CARC/RARC: ' || carc_code || '/' || rarc_code || ' | LOS days:  | Caveat: ' || caveat_notes claim_context,
   denial_source, drg_code, carc_code, caveat_notes from b)
"""
_ERR = """, e as (select upload_id, k, unnest(list_filter([case when trim(claim_id)='' then 'row ' || k || ': missing claim_id' end,
  case when trim(drg_code)='' then 'row ' || k || ': missing drg_code' end,
  case when trim(dx_code)='' then 'row ' || k || ': missing primary_diagnosis_code' end], lambda x: x is not null)) error from r),
l as (select upload_id, string_agg(error, ';' order by error) row_errors from (select distinct upload_id, error from e) group by 1),
c as (select upload_id, count(*) error_count, count(distinct k) invalid_row_count from e group by 1)
"""
ORACLE = {
    "feature_row_serving": _BASE
    + """select k row_index, dx icd9_diag_count, 0 line_icd9_diag_count, codes hcpcs_count, dx total_diag_count,
  case when blank then 0 else month(o_orderdate) end claim_month, days utilization_days, 0.0::double drg_weight, ref drg_los_reference,
  out_flag los_outlier_flag, short_flag short_stay_flag, 0 bene_hi_coverage_months, 0 bene_smi_coverage_months,
  case when blank or k%2000=7 then 0 else round(price,2) end::double bene_medreimb_ip, 0.0::double bene_medreimb_car, 0.0::double bene_benres_car,
  case when blank then 0 else greatest(year(o_orderdate)-(1920+k%70),0) end bene_age_at_claim, 0 bene_sex, chronic chronic_condition_count from s""",
    "upload_schema_check": _BASE
    + _ERR
    + """select upload_id, count(*) rows_total, any_value(error_count) error_count, any_value(invalid_row_count) invalid_row_count,
  greatest(count(*)-any_value(error_count),0) valid_rows, any_value(row_errors) row_errors, '' blocking_errors, true is_valid
  from r join c using (upload_id) join l using (upload_id) group by 1""",
    "upload_row_errors": _BASE + _ERR + "select upload_id, k row_index, error from e",
    "upload_refused": "select o_orderkey%8 upload_id, count(*) rows_total, 0 rows_scored, 0 rows_fallback, count(*) rows_rejected"
    " from orders group by 1",
    "risk_signals": _BASE + "select k row_index, array_to_string(signals,'|') signals from s",
    "reason_from_probability": _BASE + "select k row_index, denial_reason, denial_code, rationale from b",
    "preemptive_note": _BASE
    + f"select k row_index, '{up.NOTE} Priority focus: ' || array_to_string(signals,'; ') || '.' note from s",
    "threshold_flag": md._CURVE
    + "select o_orderkey row_index, ((o_orderkey%101)/100.0::double >= best_f1_threshold)::int flag,"
    " ((o_orderkey%101)/100.0::double >= 0.5)::int flag_default from orders, best",
    "row_routing": _BASE
    + "select row_index, upload_id, claim_id, status, inference_mode, denial_probability, predicted_denial_flag, threshold_used,"
    " denial_reason, denial_code, rationale, error from ro",
    "status_counts": _BASE
    + "select upload_id, count(*) rows_total, count(*) filter (status='scored') rows_scored,"
    " count(*) filter (status='fallback') rows_fallback, count(*) filter (status='rejected') rows_rejected from ro group by 1",
    "score_claim_pairing": _BASE
    + """, t as (select *, row_number() over (partition by upload_id order by coalesce(denial_probability,0) desc, row_index) a,
  row_number() over (partition by upload_id order by row_index) f from ro)
 select x.upload_id, x.denial_probability, x.denial_code, y.claim_context, y.denial_source, y.drg_code, y.carc_code, y.caveat_notes
 from t x join t y on x.upload_id=y.upload_id and x.a=1 and y.f=1""",
    "context_from_scores": _BASE
    + """, t as (select *, row_number() over (partition by upload_id order by coalesce(denial_probability,0) desc, row_index) a,
  row_number() over (partition by upload_id order by row_index) f from ro)
 select x.upload_id, y.claim_id, y.carc_code, x.denial_probability probability, x.denial_code
 from t x join t y on x.upload_id=y.upload_id and x.a=1 and y.f=1""",
    "claim_row_context": _BASE + "select row_index, claim_context context from ro",
}

# every upload has a model here, which gives one of two probabilities
_RULED = (
    _BASE.replace("(k%101)/100.0::double p", "1 / (1 + exp(case when codes>=2 then -2 else 2 end)) p")
    .replace("upload_id=3", "false")
    .replace("upload_id<>3", "true")
)
ORACLE["score_upload"] = _RULED + (
    "select row_index, upload_id, claim_id, status, inference_mode, round(denial_probability, 6) denial_probability,"
    " predicted_denial_flag, threshold_used, denial_reason, denial_code, rationale, error from ro"
)
