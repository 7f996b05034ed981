"""Claim rules, labels, features and summaries over orders seen as claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries import prepared as pt
from remitlens.functions import claims as fc
from remitlens.operators import features as ft
from remitlens.operators import labels as lb
from remitlens.operators import reports as rp
from remitlens.operators import rules as rl
from remitlens.schema import CLAIM_KEY, FEATURES, HEADER_DX, LINE_DX, LINE_STATUS, PROCEDURES
from driver_queries import adapter as ad
from remitlens.sources.claims import select_claims


def stage1(spark: SparkSession, d: str) -> DataFrame:
    return rl.stage1(
        pt.facts(spark, d),
        pt.hcpcs(spark, d),
        pt.ptp(spark, d),
        pt.links(spark, d),
    )


def passed(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the pass-through claims, handed over by Stage 1."""
    return pt.stored(spark, d, "passed", lambda s, path: lb.gate_pass_through(pt.facts(s, path), stage1(s, path)))


def triggers(spark: SparkSession, d: str) -> DataFrame:
    return lb.all_triggers(
        passed(spark, d), pt.ptp(spark, d), pt.links(spark, d), pt.drg(spark, d), strip_dots=True
    )


def labels(spark: SparkSession, d: str) -> DataFrame:
    summary = lb.claim_risk_summary(triggers(spark, d))
    return lb.train_labels(passed(spark, d), summary)


def stored_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels handed over by Stage 2a to the feature stage."""
    return pt.stored(spark, d, "labels", labels)


def features(spark: SparkSession, d: str) -> DataFrame:
    return ft.build_features(
        pt.facts(spark, d),
        stored_labels(spark, d),
        pt.drg(spark, d),
        pt.beneficiaries(spark, d),
    )


def _scan(spark, d):
    return select_claims(pt.claims(spark, d), sample_id=1).select(
        *CLAIM_KEY, "CLM_UTLZTN_DAY_CNT", "HCPCS_CD_1", "HCPCS_CD_2", "LINE_PRCSG_IND_CD_1",
        "ICD9_DGNS_CD_2", "LINE_ICD9_DGNS_CD_1",
    )


def _capped(spark, d):
    return select_claims(pt.claims(spark, d), sample_id=1, max_claims=100).select(*CLAIM_KEY)


def _flags(spark, d):
    c = pt.claims(spark, d)
    return c.select(
        "CLM_ID",
        fc.any_populated(c, HEADER_DX).alias("has_header_dx"),
        fc.any_populated(c, LINE_DX).alias("has_line_dx"),
    )


def _equals(spark, d):
    c = pt.claims(spark, d)
    return c.select(
        "CLM_ID", *[fc.any_equals(c, LINE_STATUS, x).alias(f"has_{x.lower()}") for x in "ABC"]
    )


def _counts(spark, d):
    c = pt.claims(spark, d)
    return c.select(
        "CLM_ID",
        fc.count_populated(c, HEADER_DX).alias("header_dx"),
        fc.count_populated(c, LINE_DX).alias("line_dx"),
        fc.count_populated(c, PROCEDURES).alias("procedures"),
    )


def _symptom(spark, d):
    c = pt.claims(spark, d)
    dx = F.col("LINE_ICD9_DGNS_CD_1")
    return c.select(
        "CLM_ID",
        fc.symptom_primary(dx).alias("literal"),
        fc.symptom_primary(dx, strip_dots=True).alias("dotless"),
    )


def _weights(spark, d):
    table = spark.createDataFrame(fc.procedure_weights(), "hcpcs_code string, weight double")
    codes = rl.claim_codes(pt.facts(spark, d))
    return codes.join(table, "hcpcs_code", "left").select(
        "CLM_ID", "hcpcs_code", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )


def _decision(spark, d):
    return stage1(spark, d).select(
        "CLM_ID", "stage1_reason_code", "stage1_decision", "stage1_confidence"
    )


def _los(spark, d):
    return features(spark, d).select("CLM_ID", "los_outlier_flag", "short_stay_flag")


def _chronic(spark, d):
    b = pt.beneficiaries(spark, d)
    return b.select(
        "DESYNPUF_ID",
        fc.chronic_count(b).alias("batch"),
        fc.chronic_count(b, fc.TRUTHY_SERVING, fold_case=True).alias("serving"),
    )


def _dated(spark, d):
    c = pt.claims(spark, d).select("CLM_ID", "DESYNPUF_ID", "CLM_FROM_DT")
    b = pt.beneficiaries(spark, d).select("DESYNPUF_ID", "BENE_BIRTH_DT")
    return c.join(b, "DESYNPUF_ID")


def _age(spark, d):
    birth, service = F.col("BENE_BIRTH_DT"), F.col("CLM_FROM_DT")
    return _dated(spark, d).select(
        "CLM_ID",
        fc.age_at_claim(birth, service).alias("age"),
        fc.age_at_claim_serving(birth, service).alias("age_serving"),
    )


def _month(spark, d):
    return pt.claims(spark, d).select(
        "CLM_ID",
        fc.claim_month(F.col("CLM_FROM_DT")).alias("month"),
        fc.claim_month_serving(F.col("CLM_FROM_DT")).alias("month_serving"),
        fc.claim_month_serving(F.concat(F.col("CLM_FROM_DT"), F.lit("x"))).alias("month_bad"),
    )


def _safe(spark, d):
    c = ad.table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(
        F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))
    )
    return c.select(
        "c_custkey",
        fc.safe_double(text, -1.0).alias("as_double"),
        fc.safe_int(text, -1).alias("as_int"),
    )


def _ptp_pairs(spark, d):
    return rl.canonical_pairs(pt.ptp(spark, d))


def _gate(spark, d):
    return lb.gate_pass_through(pt.facts(spark, d), stage1(spark, d)).select(*CLAIM_KEY)


def _optional(spark, d):
    """A DRG table without its stay columns: constants and fallbacks step in."""
    drg = pt.drg(spark, d).drop("geometric_mean_los")
    return drg.select(
        "drg_code",
        fc.first_available(drg, ["geometric_mean_los", "alos_hist"], "double", 0.0).alias("los"),
        fc.optional(drg, "trim_point", "double", 0.0).alias("trim_point"),
    )


def _noncovered(spark, d):
    return rl.noncovered_claims(
        rl.claim_codes(pt.facts(spark, d)), pt.hcpcs(spark, d)
    )


def _final_join(spark, d):
    from remitlens.operators import model as ml

    s1 = stage1(spark, d)
    scored = features(spark, d).select(
        *CLAIM_KEY,
        F.round(F.col("hcpcs_count") / 20 + F.col("short_stay_flag") * 0.25, 6).alias(
            ml.PROBABILITY
        ),
    )
    return ml.final_join(s1, ml.best_score_per_key(scored)).select(
        *CLAIM_KEY, "stage1_decision", ml.PROBABILITY
    )


def _best_score(spark, d):
    from remitlens.operators import model as ml

    scored = features(spark, d).select(
        *CLAIM_KEY,
        F.round(F.col("hcpcs_count") / 20 + F.col("short_stay_flag") * 0.25, 6).alias(
            ml.PROBABILITY
        ),
    )
    return ml.best_score_per_key(scored)


QUERIES = {
    "scan_claims": _scan,
    "order_limit": _capped,
    "optional_columns": _optional,
    "any_populated": _flags,
    "any_equals": _equals,
    "count_populated": _counts,
    "symptom_primary": _symptom,
    "procedure_weight": _weights,
    "stage1_decision": _decision,
    "label_case": lambda s, d: labels(s, d).select("CLM_ID", "is_denied"),
    "los_flags": _los,
    "chronic_count": _chronic,
    "age_at_claim": _age,
    "claim_month": _month,
    "safe_numeric": _safe,
    "unpivot_codes": lambda s, d: rl.unpivot_codes(pt.claims(s, d)),
    "rule_hcpcs_noncovered": _noncovered,
    "claim_code_pairs": lambda s, d: rl.claim_code_pairs(pt.facts(s, d)),
    "ptp_pairs_canonical": _ptp_pairs,
    "rule_ptp_unbundling": lambda s, d: rl.unbundled_claims(
        pt.facts(s, d), pt.ptp(s, d)
    ),
    "soft_ptp_risk": lambda s, d: lb.soft_pair_risk(passed(s, d), pt.ptp(s, d)),
    "rule_lcd_condition_unmet": lambda s, d: rl.undiagnosed_linked_claims(
        pt.facts(s, d), pt.links(s, d)
    ),
    # the trigger repeats a Stage 1 rule, so it only fires on claims that were not gated
    "soft_lcd_no_diagnosis": lambda s, d: lb.soft_no_diagnosis_risk(
        pt.facts(s, d), pt.links(s, d)
    ),
    "soft_drg_short_stay": lambda s, d: lb.soft_short_stay_risk(
        passed(s, d), pt.drg(s, d)
    ),
    "soft_symptom_definitive": lambda s, d: lb.soft_symptom_risk(passed(s, d), strip_dots=True),
    "soft_mue_frequency": lambda s, d: lb.soft_repeat_risk(passed(s, d)),
    "stage1_assemble": stage1,
    "gate_pass_through": _gate,
    "union_risk_sources": triggers,
    "claim_risk_summary": lambda s, d: lb.claim_risk_summary(triggers(s, d)),
    "label_collapse": lambda s, d: ft.collapse_labels(labels(s, d)),
    "feature_join": features,
    "max_score_per_key": _best_score,
    "final_join": _final_join,
    "rule_summary": lambda s, d: rp.rule_summary(stage1(s, d)),
    "label_summary": lambda s, d: rp.label_summary(labels(s, d)),
    "stage1_totals": lambda s, d: rp.stage1_totals(stage1(s, d)),
    "label_totals": lambda s, d: rp.label_totals(labels(s, d)),
    "feature_summary": lambda s, d: rp.feature_summary(features(s, d)).withColumns(
        {
            c: F.round(c, 6)
            for c in (
                "avg_icd9_diag_count", "avg_hcpcs_count", "avg_chronic_conditions",
                "avg_drg_weight",
            )
        }
    ),
    "stage1_validation": lambda s, d: rp.stage1_validation(stage1(s, d)).withColumns(
        {c: F.round(c, 6) for c in ("pct_observed_b", "pct_observed_c")}
    ),
    "guardrail_overlap": lambda s, d: rp.guardrail_overlap(stage1(s, d)).withColumns(
        {c: F.round(c, 6) for c in ("hard_deny_rate", "pass_rate")}
    ),
    "denial_source_top10": lambda s, d: rp.denial_source_top(labels(s, d)).withColumns(
        {c: F.round(c, 6) for c in ("share_of_top", "share_of_all")}
    ),
}

KEY = ", ".join(CLAIM_KEY)

# Orders as claims in SQL: `slots` is the long form, `claims` has one row per segment.
BASE = """
with recursive code_of as (select distinct p_brand, cast(replace(p_brand,'Brand#','') as int) b,
   case replace(p_brand,'Brand#','') when '1' then '27447' when '2' then '70553' when '3' then '96413'
     when '4' then 'E0601' else concat('H', lpad(replace(p_brand,'Brand#',''),4,'0')) end as code from part),
kinds as (select l_orderkey clm, code,
   case when l_returnflag='R' and l_tax>0.075 then 'C' when l_returnflag='R' and l_discount>0.095 then 'B'
        when l_returnflag='R' then null else 'A' end ind,
   case when l_linestatus='F' then case when p_type='PROMO' then '78650' else '4019' end end dx,
   count(*) n
  from lineitem join part on l_partkey=p_partkey join code_of using (p_brand) group by all),
pieces as (select clm, code, ind, dx, blk, least(n - blk*13, 13) size
  from (select *, unnest(range(0, (n-1)//13 + 1)) blk from kinds)),
laid as (select clm, blk, code, ind, dx, unnest(range(size)) u from pieces),
slots as (select clm, blk, (rn-1)//13 seg, (rn-1)%13+1 slot, code, ind, dx from (
   select *, row_number() over (partition by clm, blk order by code, ind nulls first, dx nulls first, u) rn
   from laid)),
seg as (select clm, blk, seg, count(*) hcpcs_count, count(dx) ldx_count,
   max(case when slot=1 then dx end) ldx1, max(case when slot=1 then code end) code1,
   max(case when slot=2 then code end) code2, max(case when slot=1 then ind end) ind1,
   coalesce(bool_or(ind='A'),false) a, coalesce(bool_or(ind='B'),false) b,
   coalesce(bool_or(ind='C'),false) c from slots group by all),
claims as (select cast(o_orderkey as varchar) CLM_ID, cast(o_custkey as varchar) DESYNPUF_ID,
   cast(1 + o_orderkey % 2 as int) sample_id, strftime(o_orderdate, '%Y%m%d') CLM_FROM_DT,
   strftime(cast(o_orderdate as date) + cast(o_orderkey % 15 as int), '%Y%m%d') CLM_THRU_DT,
   case when o_orderstatus='P' then cast(200+c_nationkey as varchar) end CLM_DRG_CD,
   cast(o_orderkey % 15 as int) util,
   case when o_orderpriority='4-NOT SPECIFIED' then null when o_orderpriority='5-LOW' then '78650' else '25000' end dx1,
   case when o_orderpriority='1-URGENT' then '4280' end dx2,
   o_orderkey clm, coalesce(hcpcs_count,0) hcpcs_count, coalesce(ldx_count,0) ldx_count, ldx1, code1, code2, ind1,
   coalesce(a,false) a, coalesce(b,false) b, coalesce(c,false) c
  from orders join customer on o_custkey=c_custkey left join seg on o_orderkey=clm),
ptp as (select x.code code1, y.code code2,
   case when (x.b+y.b)%3=0 then '0' when (x.b+y.b)%3=1 then '1' else '9' end modifier
  from code_of x join code_of y on x.b<>y.b where (x.b*7+y.b*3)%23=0),
ptp_pairs as (select distinct least(code1,code2) code_lo, greatest(code1,code2) code_hi, modifier from ptp),
pairs as (select distinct x.clm, x.code code_lo, y.code code_hi from slots x join slots y on x.clm=y.clm and x.code<y.code),
nonc as (select distinct clm from slots where code='H0013'),
unb as (select distinct clm from pairs join ptp_pairs using (code_lo, code_hi) where modifier='0'),
unmet as (select distinct c.clm from claims c join slots s on c.clm=s.clm
   where s.code>='H0018' and c.dx1 is null and c.dx2 is null and c.ldx_count=0),
s1 as (select claims.*, n.clm is not null rule_hcpcs_noncovered, u.clm is not null rule_ptp_unbundling,
   m.clm is not null rule_lcd_condition_unmet,
   case when n.clm is not null then 'HCPCS_NONCOVERED' when u.clm is not null then 'PTP_UNBUNDLING'
        when m.clm is not null then 'LCD_CONDITION_UNMET' else 'NONE' end stage1_reason_code
  from claims left join nonc n using (clm) left join unb u using (clm) left join unmet m using (clm)),
stage1 as (select *, case when stage1_reason_code='NONE' then 'PASS_TO_ML' else 'HARD_DENY' end stage1_decision,
   case when stage1_reason_code='NONE' then 0.0::double else 1.0::double end stage1_confidence,
   b observed_has_b, c observed_has_c from s1),
pass as (select * from stage1 where stage1_decision='PASS_TO_ML'),
pslots as (select * from slots where clm in (select clm from pass)),
drg as (select cast(200+n_nationkey as varchar) drg_code, 1.0::double + n_nationkey/10 weight,
   case when n_nationkey%4<>0 then 2.5::double + n_nationkey%7 end geometric_mean_los,
   3.0::double + n_nationkey%9 alos_hist from nation),
t_pair as (select distinct cast(p.clm as varchar) CLM_ID, 0.6::double weight, 'ptp_conflict' source_name
   from pairs p join ptp_pairs using (code_lo, code_hi) where p.clm in (select clm from pass)),
t_mue as (select cast(clm as varchar) CLM_ID, 0.5::double weight, 'mue_frequency' source_name
   from pslots group by clm, code having count(*)>1),
t_drg as (select distinct CLM_ID, 0.85::double weight, 'drg_shortstay_upcoding' source_name
   from pass join drg on CLM_DRG_CD=drg_code
   where util>=1 and coalesce(alos_hist,weight,0)>0 and util<0.5*coalesce(alos_hist,weight,0)),
t_sym as (select p.CLM_ID, max(case s.code when '27447' then 1.0 when '70553' then 0.7 when '96413' then 1.0
     when 'E0601' then 0.8 end)::double weight, 'symptom_primary_definitive_proc' source_name
   from pass p join pslots s on p.clm=s.clm
   where p.ldx1='78650' and s.code in ('27447','70553','96413','E0601') group by p.CLM_ID),
triggers as (select * from t_pair union all select * from t_mue union all select * from t_drg union all select * from t_sym),
risk as (select CLM_ID, max(weight) denial_confidence, string_agg(distinct source_name, '|' order by source_name) denial_sources
   from triggers group by CLM_ID),
labels as (select p.*, coalesce(denial_confidence,0.0)::double denial_confidence, coalesce(denial_sources,'') denial_sources,
   case when b or c then null when r.CLM_ID is not null then 1 when a then 0 end is_denied
   from pass p left join risk r using (CLM_ID)),
bene as (select cast(c_custkey as varchar) DESYNPUF_ID, cast(1920 + c_custkey%70 as int) birth_year,
   cast(c_custkey%13 as int) hi, cast(case when c_custkey%5<>0 then c_custkey%12 else 0 end as int) smi,
   c_acctbal ip, case when c_acctbal>0 then c_acctbal*2 else 0 end car, c_acctbal/4 res,
   cast(1+c_nationkey%2 as int) sex,
   cast((c_custkey&1)+((c_custkey>>1)&1)+((c_custkey>>2)&1)+((c_custkey>>3)&1)+((c_custkey>>4)&1)+((c_custkey>>5)&1)
     +((c_custkey>>6)&1)+((c_custkey>>7)&1) as int) chronic from customer),
collapsed as (select CLM_ID, DESYNPUF_ID, sample_id, CLM_FROM_DT, CLM_THRU_DT, CLM_DRG_CD, max(is_denied) is_denied
   from labels group by all),
feats as (select l.CLM_ID, l.DESYNPUF_ID, l.sample_id, l.is_denied,
   (case when dx1 is null then 0 else 1 end)+(case when dx2 is null then 0 else 1 end) icd9_diag_count,
   cast(ldx_count as int) line_icd9_diag_count, cast(hcpcs_count as int) hcpcs_count,
   (case when dx1 is null then 0 else 1 end)+(case when dx2 is null then 0 else 1 end)+cast(ldx_count as int) total_diag_count,
   cast(substr(c.CLM_FROM_DT,5,2) as int) claim_month, util::double utilization_days,
   coalesce(d.weight,0)::double drg_weight, coalesce(d.geometric_mean_los,d.alos_hist,0)::double drg_los_reference,
   case when coalesce(d.geometric_mean_los,d.alos_hist,0)>0 and util>1.5*coalesce(d.geometric_mean_los,d.alos_hist,0) then 1 else 0 end los_outlier_flag,
   case when coalesce(d.geometric_mean_los,d.alos_hist,0)>0 and util<0.5*coalesce(d.geometric_mean_los,d.alos_hist,0) then 1 else 0 end short_stay_flag,
   hi bene_hi_coverage_months, smi bene_smi_coverage_months, ip bene_medreimb_ip, car bene_medreimb_car, res bene_benres_car,
   cast(substr(c.CLM_FROM_DT,1,4) as int)-birth_year bene_age_at_claim, sex bene_sex, chronic chronic_condition_count,
   c.CLM_FROM_DT, c.CLM_THRU_DT, c.CLM_DRG_CD
  from collapsed l join claims c on l.CLM_ID=c.CLM_ID left join drg d on c.CLM_DRG_CD=d.drg_code
  left join bene b on l.DESYNPUF_ID=b.DESYNPUF_ID),
scored as (select CLM_ID, DESYNPUF_ID, sample_id, CLM_FROM_DT, CLM_THRU_DT, CLM_DRG_CD,
   max(round(hcpcs_count/20 + short_stay_flag*0.25, 6))::double stage2_denial_probability from feats group by all)
"""

_TOTALS = """count(*) total_claims, count(*) filter (stage1_decision='HARD_DENY') hard_deny_claims,
  count(*) filter (stage1_decision='PASS_TO_ML') pass_to_ml_claims,
  count(*) filter (observed_has_b) observed_b_claims, count(*) filter (observed_has_c) observed_c_claims"""

_SELECTS = {
    "scan_claims": f"select {KEY}, cast(util as varchar) CLM_UTLZTN_DAY_CNT, code1 HCPCS_CD_1, code2 HCPCS_CD_2,"
    " ind1 LINE_PRCSG_IND_CD_1, dx2 ICD9_DGNS_CD_2, ldx1 LINE_ICD9_DGNS_CD_1 from claims where sample_id=1",
    "order_limit": f"select {KEY} from claims where sample_id=1 order by CLM_ID, DESYNPUF_ID limit 100",
    "optional_columns": "select drg_code, alos_hist los, 0.0::double trim_point from drg",
    "any_populated": "select CLM_ID, dx1 is not null or dx2 is not null has_header_dx, ldx_count>0 has_line_dx from claims",
    "any_equals": "select CLM_ID, a has_a, b has_b, c has_c from claims",
    "count_populated": "select CLM_ID, (case when dx1 is null then 0 else 1 end)+(case when dx2 is null then 0 else 1 end) header_dx,"
    " cast(ldx_count as int) line_dx, cast(hcpcs_count as int) procedures from claims",
    "symptom_primary": "select CLM_ID, false literal, coalesce(ldx1='78650', false) dotless from claims",
    "procedure_weight": "select cast(clm as varchar) CLM_ID, code hcpcs_code, (case code when '27447' then 1.0 when '70553' then 0.7"
    " when '96413' then 1.0 when 'E0601' then 0.8 else 0 end)::double weight from slots",
    "stage1_decision": "select CLM_ID, stage1_reason_code, stage1_decision, stage1_confidence from stage1",
    "label_case": "select CLM_ID, is_denied from labels",
    "los_flags": "select CLM_ID, los_outlier_flag, short_stay_flag from feats",
    "chronic_count": "select DESYNPUF_ID, chronic batch, chronic serving from bene",
    "age_at_claim": "select CLM_ID, cast(substr(CLM_FROM_DT,1,4) as int)-birth_year age,"
    " greatest(cast(substr(CLM_FROM_DT,1,4) as int)-birth_year,0) age_serving from claims join bene using (DESYNPUF_ID)",
    "claim_month": "select CLM_ID, cast(substr(CLM_FROM_DT,5,2) as int) as month, cast(substr(CLM_FROM_DT,5,2) as int) month_serving, 0 month_bad from claims",
    "safe_numeric": "select c_custkey, case when c_custkey%7=0 then -1.0 else c_acctbal end::double as_double,"
    " cast(case when c_custkey%7=0 then -1 else trunc(c_acctbal) end as int) as_int from customer",
    "unpivot_codes": "select cast(s.clm as varchar) CLM_ID, cast(o_custkey as varchar) DESYNPUF_ID,"
    " strftime(o_orderdate,'%Y%m%d') CLM_FROM_DT, code hcpcs_code from slots s join orders on s.clm=o_orderkey",
    "rule_hcpcs_noncovered": "select cast(clm as varchar) CLM_ID from nonc",
    "claim_code_pairs": "select cast(clm as varchar) CLM_ID, code_lo, code_hi from pairs",
    "ptp_pairs_canonical": "select code_lo, code_hi, modifier from ptp_pairs",
    "rule_ptp_unbundling": "select cast(clm as varchar) CLM_ID from unb",
    "soft_ptp_risk": "select * from t_pair",
    "rule_lcd_condition_unmet": "select cast(clm as varchar) CLM_ID from unmet",
    "soft_lcd_no_diagnosis": "select cast(clm as varchar) CLM_ID, 0.7::double weight, 'lcd_no_diagnosis' source_name from unmet",
    "soft_drg_short_stay": "select * from t_drg",
    "soft_symptom_definitive": "select * from t_sym",
    "soft_mue_frequency": "select * from t_mue",
    "stage1_assemble": f"select {KEY}, rule_hcpcs_noncovered, rule_ptp_unbundling, rule_lcd_condition_unmet,"
    " observed_has_b, observed_has_c, stage1_reason_code, stage1_decision, stage1_confidence from stage1",
    "gate_pass_through": f"select {KEY} from pass",
    "union_risk_sources": "select * from triggers",
    "claim_risk_summary": "select * from risk",
    "label_collapse": "select * from collapsed",
    "feature_join": f"select CLM_ID, DESYNPUF_ID, sample_id, is_denied, {', '.join(FEATURES)}, CLM_FROM_DT, CLM_THRU_DT, CLM_DRG_CD from feats",
    "max_score_per_key": "select * from scored",
    "final_join": f"select {', '.join('s.' + k for k in CLAIM_KEY)}, s.stage1_decision,"
    " case when s.stage1_decision='HARD_DENY' then null else p.stage2_denial_probability end stage2_denial_probability"
    " from stage1 s left join scored p on s.CLM_ID=p.CLM_ID",
    "rule_summary": "select stage1_reason_code, stage1_decision, count(*) claim_count from stage1 group by all",
    "label_summary": "select is_denied, denial_sources, count(*) claim_count from labels where is_denied is not null group by all",
    "stage1_totals": f"select {_TOTALS} from stage1",
    "label_totals": "select count(*) total_rows, count(*) filter (is_denied=1) denied_rows, count(*) filter (is_denied=0) approved_rows,"
    " count(*) filter (is_denied is null) unlabeled_rows from labels",
    "feature_summary": "select count(*) total_rows, count(*) filter (is_denied=1) denied_rows, count(*) filter (is_denied=0) approved_rows,"
    " round(avg(icd9_diag_count),6) avg_icd9_diag_count, round(avg(hcpcs_count),6) avg_hcpcs_count,"
    " round(avg(chronic_condition_count),6) avg_chronic_conditions, round(avg(drg_weight),6) avg_drg_weight from feats",
    "stage1_validation": "select stage1_reason_code, stage1_decision, count(*) claim_count,"
    " round(avg(observed_has_b::int),6) pct_observed_b, round(avg(observed_has_c::int),6) pct_observed_c from stage1 group by all",
    "guardrail_overlap": f"""select {_TOTALS}, count(*) filter (stage1_decision='HARD_DENY' and observed_has_b) hard_deny_with_b,
  count(*) filter (stage1_decision='HARD_DENY' and observed_has_c) hard_deny_with_c,
  count(*) filter (stage1_decision='HARD_DENY' and not observed_has_b and not observed_has_c) hard_deny_without_bc,
  round(count(*) filter (stage1_decision='HARD_DENY')/count(*),6) hard_deny_rate,
  round(count(*) filter (stage1_decision='PASS_TO_ML')/count(*),6) pass_rate from stage1""",
    "denial_source_top10": """, g as (select denial_sources, count(*) claim_count from labels where is_denied=1 group by all),
 t as (select * from g order by claim_count desc, denial_sources limit 10)
 select denial_sources, claim_count, round(100.0*claim_count/(select sum(claim_count) from t),6)::double share_of_top,
  round(100.0*claim_count/(select sum(claim_count) from g),6)::double share_of_all from t""",
}

ORACLE = {name: BASE + select for name, select in _SELECTS.items()}
