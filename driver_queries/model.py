"""Feature matrix, splits, metrics, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import claims as cl
from driver_queries import prepared as pt
from remitlens.operators import evaluate as ev
from remitlens.operators import model as ml
from remitlens.operators import reports as rp
from remitlens.schema import AUDIT_COLUMNS, CLAIM_KEY, FEATURES
from driver_queries import adapter as ad


def stored_features(spark, d):
    """Features handed over by Stage 2b."""
    return pt.stored(spark, d, "features", cl.features)


def scored_lines(spark, d):
    """Line items as a scored table with heavy ties."""
    line = ad.table(spark, d, "lineitem")
    return line.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.round(F.col("l_discount") * 8 + F.col("l_quantity") / 250, 4).alias("score"),
    )


def score_counts(spark, d):
    """Counts per distinct score, handed from metric to metric."""
    return pt.stored(spark, d, "score_counts", lambda s, path: ev.score_counts(scored_lines(s, path)))


def curve(spark, d):
    return pt.stored(spark, d, "curve", lambda s, path: ev.pr_curve(score_counts(s, path)))


def metrics(spark, d):
    """The metrics row with the columns of a training run, over the scored lines."""
    counts = score_counts(spark, d)
    sizes = ev.row_sizes(counts).select(
        F.lit(1).alias("sample_id"), F.col("rows_total"), F.col("rows_total").alias("rows_all_features"), "positive_rate"
    )
    return ev.metrics_row(counts, sizes, curve(spark, d))


def operating(spark, d):
    return ev.operating_table(score_counts(spark, d), ev.best_f1(curve(spark, d)))


def _rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _curve(spark, d):
    return _rounded(curve(spark, d).drop("prev_recall"), ["precision", "recall"])


def _metrics(spark, d):
    m = metrics(spark, d)
    return _rounded(m, [c for c in m.columns if c not in ("sample_id", "rows_total", "rows_all_features")])


def _operating(spark, d):
    return _rounded(operating(spark, d), ["precision", "recall", "f1"])


def _labelled(spark, d):
    return ml.labelled_only(stored_features(spark, d))


def _matrix(spark, d):
    return ml.feature_matrix(stored_features(spark, d), keep=["CLM_ID"])


def _split(spark, d):
    return ml.patient_split(_labelled(spark, d)).select("CLM_ID", "DESYNPUF_ID", "is_train")


def _membership(spark, d):
    """Rows and patients on each side of the split, and patients on both."""
    rows = ml.patient_split(_labelled(spark, d))
    by_patient = rows.groupBy("DESYNPUF_ID").agg(
        F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test")
    )
    return by_patient.agg(
        F.sum("train").alias("train_rows"),
        F.sum("test").alias("test_rows"),
        F.count_if(F.col("train") > 0).alias("train_patients"),
        F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("patients_on_both"),
    )


def sides(spark, d):
    """Labelled rows with their side, split once."""
    return pt.stored(spark, d, "sides", lambda s, path: ml.three_sides(_labelled(s, path)))


def _val_split(spark, d):
    return sides(spark, d).where("side <> 'test'").select(*CLAIM_KEY, "is_denied", (F.col("side") == "val").alias("is_val"))


def _balance(spark, d):
    return _rounded(
        ml.class_balance(_labelled(spark, d)), ["positive_weight", "positive_rate"]
    )


def _leakage(spark, d):
    """A clean table passes; the label table, which holds the sources, does not."""
    features = stored_features(spark, d)
    ml.check_leakage(features)
    try:
        ml.check_leakage(cl.stored_labels(spark, d))
        refused = False
    except ml.LeakageError:
        refused = True
    return features.agg(F.count("*").alias("rows")).withColumn("refused", F.lit(refused))


def _columns(spark, d):
    """Columns shared by features and claims, and those only the features have."""
    have, base = stored_features(spark, d), pt.claims(spark, d)
    shared = [c for c in have.columns if c in set(base.columns)]
    return have.agg(F.count("*").alias("rows")).withColumns(
        {
            "shared": F.lit(",".join(sorted(shared))),
            "added": F.lit(",".join(sorted(set(have.columns) - set(shared)))),
        }
    )


_MODELS: dict[tuple[str, str, str], object] = {}


def _fitted(spark, d, name, fit):
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def model(spark, d):
    """Boosted trees at the published settings."""
    return _fitted(spark, d, "trees", lambda: ml.train_gbt(stored_features(spark, d)))


#: One tree on a label that one feature decides: its leaves are -1 and 1, so the
#: probability is 1 / (1 + exp(2)) or 1 / (1 + exp(-2)).
ONE_TREE = ml.TreeSettings(trees=1, depth=1, row_share=1.0, column_share="all", min_rows=1)


def rule_model(spark, d):
    ruled = stored_features(spark, d).withColumn("is_denied", (F.col("hcpcs_count") >= 2).cast("int"))
    return _fitted(spark, d, "rule", lambda: ml.train_gbt(ruled, ONE_TREE))


#: Many one-split trees over one yes/no feature: each leaf is a weighted mean of residuals,
#: so the margins follow from four counts by a recursion that SQL can write.
STUMPS = ml.TreeSettings(trees=20, depth=1, row_share=1.0, column_share="all", min_rows=1, patience=None)


def _with_signal(df):
    return df.withColumn("signal", (F.col("hcpcs_count") >= 2).cast("int"))


def stump_model(spark, d):
    seen = _with_signal(stored_features(spark, d)).select(*CLAIM_KEY, "is_denied", "signal")
    return _fitted(spark, d, "stumps", lambda: ml.train_gbt(seen, STUMPS))


def _train(spark, d):
    """Boosted stumps against the recursion, per value of their feature, and the quality of
    the published settings on the held-out patients against what any use needs."""
    fitted = model(spark, d)
    test = sides(spark, d).where("side = 'test'")
    scored = ml.score(fitted, test, ["is_denied"]).select(
        F.col("is_denied").alias("label"), F.col(ml.PROBABILITY).alias("score")
    )
    counts = ev.score_counts(scored)
    quality = ev.metrics_row(counts, ev.row_sizes(counts))
    better = (F.col("pr_auc") > 1.25 * F.col("positive_rate")).alias("better")
    stumps = ml.score(stump_model(spark, d), _with_signal(test), ["signal", "is_denied"])
    return (
        stumps.groupBy("signal")
        .agg(
            F.count("*").alias("rows_test"),
            F.round(F.avg("is_denied"), 6).alias("positive_rate"),
            F.round(F.max(ml.PROBABILITY), 6).alias("probability"),
            F.count_distinct(F.round(ml.PROBABILITY, 9)).alias("probabilities"),
        )
        .withColumn("trees", F.lit(stump_model(spark, d).stages[-1].getNumTrees))
        .withColumn("well_above_chance", quality.select(better).scalar())
        .withColumn("many_trees", F.lit(fitted.stages[-1].getNumTrees >= 10))
    )


def _score(spark, d):
    """All rows scored by the trees, by the stumps and by the one-tree model; the answers
    of the last two are known."""
    keep = [*CLAIM_KEY, "is_denied"]
    rows = _with_signal(stored_features(spark, d))
    ruled = ml.score(rule_model(spark, d), rows, [*keep, *FEATURES, "signal"])
    ruled = ruled.withColumnRenamed(ml.PROBABILITY, "rule_probability")
    stumps = ml.score(stump_model(spark, d), ruled, [*keep, *FEATURES, "signal", "rule_probability"])
    stumps = stumps.withColumnRenamed(ml.PROBABILITY, "boosted_probability")
    scored = ml.score(model(spark, d), stumps, [*keep, "rule_probability", "boosted_probability"])
    return scored.select(
        *keep,
        F.round("rule_probability", 6).alias("rule_probability"),
        F.round("boosted_probability", 6).alias("boosted_probability"),
        F.col(ml.PROBABILITY).between(0.0, 1.0).alias("is_probability"),
    )


def _report(spark, d):
    return rp.markdown_report(
        cl.stage1(spark, d), metrics(spark, d), operating(spark, d), cl.stored_labels(spark, d), sample_id=1
    )


QUERIES = {
    "pr_curve": _curve,
    "average_precision": lambda s, d: _rounded(
        ev.average_precision(curve(s, d)), ["pr_auc"]
    ),
    "best_f1_threshold": lambda s, d: _rounded(
        ev.best_f1(curve(s, d)),
        ["best_f1_threshold", "best_f1", "best_precision", "best_recall"],
    ),
    "recall_at_precision": lambda s, d: _rounded(
        ev.recall_at_precision(curve(s, d), 0.34),
        ["recall_at_precision_080"],
    ),
    "pr_operating_table": _operating,
    "evaluate": _metrics,
    "feature_matrix": _matrix,
    "labelled_only": lambda s, d: _labelled(s, d).select(*CLAIM_KEY, "is_denied"),
    "patient_split": _split,
    "patient_membership": _membership,
    "stratified_val_split": _val_split,
    "class_balance": _balance,
    "leakage_check": _leakage,
    "column_set_ops": _columns,
    "train_gbt": _train,
    "score_batch": _score,
    "report_markdown": _report,
}

_CURVE = """with s as (select (l_returnflag='R')::int as label, round(l_discount*8 + l_quantity/250, 4) score from lineitem),
g as (select score, count(*) filter (label=1) pos, count(*) filter (label=0) neg from s group by 1),
cu as (select score threshold, sum(pos) over (order by score desc) tp, sum(neg) over (order by score desc) fp,
   sum(pos) over () ap, pos from g),
curve as (select threshold, tp::bigint tp, fp::bigint fp, tp/(tp+fp) as precision, tp/ap recall, (tp-pos)/ap prev_recall from cu),
ap as (select sum((recall-prev_recall)*precision) pr_auc from curve),
best as (select threshold best_f1_threshold, 2*precision*recall/(precision+recall+1e-10) best_f1,
   precision best_precision, recall best_recall from curve order by 2 desc, 1 limit 1),
points as (select 0 point, 0.2::double threshold union all select 1, 0.3 union all select 2, 0.4 union all select 3, 0.5
   union all select 4, best_f1_threshold from best),
op as (select point, threshold, count(*) filter (score>=threshold and label=1)/greatest(count(*) filter (score>=threshold),1) as precision,
   count(*) filter (score>=threshold and label=1)/count(*) filter (label=1) recall,
   2*count(*) filter (score>=threshold and label=1)/(count(*) filter (score>=threshold)+count(*) filter (label=1)) f1
   from points, s group by 1, 2)
"""
_LABELLED = ", lab as (select * from feats where is_denied is not null)"


def _hash(text: str) -> str:
    return f"cast(('0x' || substr(md5({text}),1,15)) as bigint)"


_ROW = _hash(
    "concat_ws('|','val',CLM_ID,DESYNPUF_ID,cast(sample_id as varchar),CLM_FROM_DT,CLM_THRU_DT,coalesce(CLM_DRG_CD,''))"
)
#: Exactly a fifth of the patients is held out, and a fifth of the rows of each label of the others.
_SIDES = (
    _LABELLED
    + f""", pat as (select pid, row_number() over (order by {_hash('pid')}) rn, count(*) over () n from (select distinct coalesce(DESYNPUF_ID,'') pid from lab)),
sided as (select lab.*, {_ROW} spread, rn <= n - (n*20+99)//100 is_train from lab join pat on pid = coalesce(DESYNPUF_ID,'')),
borders as (select is_denied, max(spread) cut from (select is_denied, spread, row_number() over (partition by is_denied order by spread) rn,
    count(*) over (partition by is_denied) n from sided where is_train) where rn <= (n*20+99)//100 group by 1),
sides as (select s.*, case when not is_train then 'test' when spread <= cut then 'val' else 'train' end side, (hcpcs_count >= 2)::int signal
  from sided s left join borders b using (is_denied))"""
)
_STUMPS = f""", bal as (select greatest(count(*) filter (is_denied=0),1)/greatest(count(*) filter (is_denied=1),1) w from sides where side='train'),
g as (select signal, count(*) filter (is_denied=1)*any_value(w) a, count(*) filter (is_denied=0)::double b from sides, bal where side='train' group by 1),
boost as (select 1 k, signal, a, b, (a-b)/(a+b) m from g
  union all select k+1, signal, a, b, m + {STUMPS.step}*4*(a/(1+exp(2*m)) - b/(1+exp(-2*m)))/(a+b) from boost where k < {STUMPS.trees}),
stumps as (select signal, 1/(1+exp(-2*m)) probability from boost where k = {STUMPS.trees})"""

ORACLE = {
    "pr_curve": _CURVE
    + "select threshold, tp, fp, round(precision,6) as precision, round(recall,6) recall from curve",
    "average_precision": _CURVE + "select round(pr_auc,6) pr_auc from ap",
    "best_f1_threshold": _CURVE
    + "select round(best_f1_threshold,6) best_f1_threshold, round(best_f1,6) best_f1,"
    " round(best_precision,6) best_precision, round(best_recall,6) best_recall from best",
    "recall_at_precision": _CURVE
    + "select round(coalesce(max(recall),0),6) recall_at_precision_080 from curve where precision>=0.34",
    "pr_operating_table": _CURVE
    + "select point, threshold, round(precision,6) as precision, round(recall,6) recall, round(f1,6) f1 from op",
    "evaluate": _CURVE
    + """select 1 sample_id, (select count(*) from s) rows_total, (select count(*) from s) rows_all_features, (select round(avg(label),6) from s) positive_rate,
 (select round(pr_auc,6) from ap) pr_auc, round(best_f1_threshold,6) best_f1_threshold, round(best_f1,6) best_f1,
 round(best_precision,6) best_precision, round(best_recall,6) best_recall,
 (select round(f1,6) from op where point=0) f1_at_020, (select round(f1,6) from op where point=1) f1_at_030,
 (select round(f1,6) from op where point=2) f1_at_040, (select round(f1,6) from op where point=3) f1_at_050,
 (select round(coalesce(max(recall),0),6) from curve where precision>=0.8) recall_at_precision_080 from best""",
    "feature_matrix": cl.BASE
    + "select CLM_ID, "
    + ", ".join(f"coalesce({c},0)::double {c}" for c in FEATURES)
    + " from feats",
    "labelled_only": cl.BASE + _LABELLED + f" select {cl.KEY}, is_denied from lab",
    "patient_split": cl.BASE + _SIDES + " select CLM_ID, DESYNPUF_ID, is_train from sides",
    "patient_membership": cl.BASE
    + _SIDES
    + ", p as (select DESYNPUF_ID, count(*) filter (is_train) train, count(*) filter (not is_train) test from sides group by 1)"
    " select sum(train)::bigint train_rows, sum(test)::bigint test_rows, count(*) filter (train>0) train_patients,"
    " count(*) filter (train>0 and test>0) patients_on_both from p",
    "stratified_val_split": cl.BASE
    + _SIDES
    + f" select {cl.KEY}, is_denied, side='val' is_val from sides where side<>'test'",
    "class_balance": cl.BASE
    + _LABELLED
    + " select greatest(count(*) filter (is_denied=0),1) negatives, greatest(count(*) filter (is_denied=1),1) positives,"
    " round(avg(is_denied),6) positive_rate,"
    " round(greatest(count(*) filter (is_denied=0),1)/greatest(count(*) filter (is_denied=1),1),6) positive_weight from lab",
    "leakage_check": cl.BASE + " select count(*) as rows, true refused from feats",
    "column_set_ops": cl.BASE
    + " select count(*) as rows, '"
    + ",".join(sorted(set(["CLM_ID", "DESYNPUF_ID", "sample_id", *AUDIT_COLUMNS])))
    + "' shared, '"
    + ",".join(sorted([*FEATURES, "is_denied"]))
    + "' added from feats",
}


def _report_sql():
    def lines(section, table, texts):
        listed = ", ".join(t if t.startswith("(") else f"'{t}'" for t in texts)
        return f"select {section} section, unnest(range({len(texts)}))::int as line, unnest([{listed}]) as text from {table}"

    def n(text, column, end=""):
        return f"('{text}' || format('{{:,}}', {column}::bigint) || '{end}')"

    def rate(text, count, total):
        return f"('{text}' || format('{{:,}}', {count}) || ' (' || printf('%.2f', {count} / {total} * 100) || '%)')"

    def f4(text, column):
        return f"('{text}' || printf('%.4f', {column}::double))"

    first = [
        "# Sample 01 Performance Report", "", "## Stage 1 (Deterministic Rules)", "",
        n("- Total claims: ", "total_claims"), rate("- Hard deny: ", "hard_deny_claims", "total_claims"),
        rate("- Pass to ML: ", "pass_to_ml_claims", "total_claims"),
        n("- Observed B (guardrail): ", "observed_b_claims"), n("- Observed C (guardrail): ", "observed_c_claims"),
        n("- Hard deny ∩ observed B: ", "deny_b"), n("- Hard deny ∩ observed C: ", "deny_c"),
        n("- Hard deny without B/C (potential contradiction bucket): ", "deny_none"),
    ]
    second = [
        "", "## Stage 2 (Boosted trees)", "### Primary Metrics", "",
        n("- Rows total: ", "rows_total"), f4("- Positive rate: ", "positive_rate"), f4("- PR-AUC: ", "pr_auc"), "",
        "### Best Threshold Performance (Patient-level split)", "",
        f4("- Best F1 threshold: ", "best_f1_threshold"), f4("- F1 @ best threshold: ", "best_f1"),
        f4("- Precision @ best threshold: ", "best_precision"), f4("- Recall @ best threshold: ", "best_recall"), "",
        "### High-Precision Operating Point", "", f4("- Recall @ Precision>=0.80: ", "recall_080"), "",
        "### PR Operating Table", "", "| Threshold | Precision | Recall | F1 |", "|-----------|-----------|--------|----|",
    ]
    head = [
        "", "### Denial Source Breakdown (Test Set Positives)", "",
        "| Source(s) | Count | Percentage |", "|-----------|-------|------------|",
    ]
    notes = [
        "", "## Notes", "",
        "- Stage 1 B/C values are used for calibration only and excluded from Stage 2 target labels.",
        "- MUE is treated as a soft feature in SynPUF context (no service unit fields).",
        n("- Current contradiction bucket size: ", "deny_none", " claims."),
        "- Patient-level split prevents same beneficiary appearing in both train and test sets.",
        "- Best threshold optimized for F1 score on test set; may differ from fixed 0.50 threshold.",
    ]
    deny = "count(*) filter (stage1_decision='HARD_DENY'"
    return f"""{cl.BASE},
mx as ({_CURVE} select (select count(*) from s) rows_total, (select avg(label) from s) positive_rate, (select pr_auc from ap) pr_auc,
  best.*, (select coalesce(max(recall),0) from curve where precision>=0.8) recall_080 from best),
ot as ({_CURVE} select point, threshold, precision as p, recall r, f1 from op),
ov as (select {cl._TOTALS}, {deny} and observed_has_b) deny_b, {deny} and observed_has_c) deny_c,
  {deny} and not observed_has_b and not observed_has_c) deny_none from stage1),
src as (select denial_sources, count(*) n from labels where is_denied=1 group by all order by 2 desc, 1 limit 10)
{lines(1, "ov", first)} union all {lines(2, "mx", second)}
union all select 3, (row_number() over (order by point) - 1)::int,
  '| ' || printf('%.4f', threshold::double) || ' | ' || printf('%.4f', p::double) || ' | ' || printf('%.4f', r::double) || ' | ' || printf('%.4f', f1::double) || ' |' from ot
union all {lines(4, "(select 1 from src limit 1)", head)}
union all select 5, (row_number() over (order by n desc, denial_sources) - 1)::int,
  '| ' || case when denial_sources='' then 'none' else denial_sources end || ' | ' || format('{{:,}}', n) || ' | '
  || printf('%.2f', 100.0::double * n / (select sum(n) from src)) || '% |' from src
union all {lines(6, "ov", notes)}"""


ORACLE["report_markdown"] = _report_sql()
ORACLE["train_gbt"] = (
    cl.BASE
    + _SIDES
    + _STUMPS
    + f""" select signal, count(*) rows_test, round(avg(is_denied), 6) positive_rate, round(any_value(probability), 6) probability,
  1 probabilities, {STUMPS.trees} trees, true well_above_chance, true many_trees
  from sides join stumps using (signal) where side='test' group by 1"""
)
ORACLE["score_batch"] = (
    cl.BASE
    + _SIDES
    + _STUMPS
    + f" select {cl.KEY}, is_denied, round(1 / (1 + exp(case when hcpcs_count >= 2 then -2 else 2 end)), 6) rule_probability,"
    " round(probability, 6) boosted_probability, true is_probability from feats join stumps on signal = (hcpcs_count >= 2)::int"
)
