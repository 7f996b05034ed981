"""Claim functions, rules, labels and features on small hand-made tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from remitlens.functions import claims as fc
from remitlens.operators import features as ft
from remitlens.operators import labels as lb
from remitlens.operators import model as ml
from remitlens.operators import rules as rl
from remitlens.schema import CLAIMS_SCHEMA, LINE_STATUS, PROCEDURES
from remitlens.session import cut_lineage

KEY = dict(sample_id=1, DESYNPUF_ID="p", CLM_FROM_DT="19910101", CLM_THRU_DT="19910102")


def claims(spark, *rows):
    """A claims table with the key columns and the slots the rows use."""
    used = {*ml.CLAIM_KEY, "CLM_UTLZTN_DAY_CNT"}.union(*rows)
    schema = StructType([f for f in CLAIMS_SCHEMA.fields if f.name in used])
    data = [tuple({**KEY, **r}.get(n) for n in schema.names) for r in rows]
    return spark.createDataFrame(data, schema)


def facts_of(table):
    """Facts as the run hands them over: stored."""
    return cut_lineage(rl.fold_claims(table), "facts")


def ids(df):
    return sorted(r.CLM_ID for r in df.collect())


@pytest.fixture(scope="module")
def ptp(spark):
    return spark.createDataFrame(
        [(" B", "A", "0"), ("A", "B ", "1"), ("C", "A", "1"), ("", "Z", "0"), (None, "Q", "0")],
        "code1 string, code2 string, modifier string",
    )


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([("a1", " L "), ("a2", "L"), ("a3", "")], "article_id string, hcpcs_code string")


@pytest.fixture(scope="module")
def hcpcs(spark):
    return spark.createDataFrame([("N", True), ("A", False), ("B", None)], "hcpcs_code string, is_noncovered boolean")


def test_unpivot_trims_and_keeps_repeats(spark):
    df = claims(spark, dict(CLM_ID="1", HCPCS_CD_1="A", HCPCS_CD_2=" A ", HCPCS_CD_3="", HCPCS_CD_45="A"))
    assert [r.hcpcs_code for r in rl.unpivot_codes(df).collect()] == ["A", "A", "A"]
    assert df.select(fc.count_populated(df, PROCEDURES)).first()[0] == 3


def test_line_flag(spark):
    df = claims(spark, dict(CLM_ID="1", LINE_PRCSG_IND_CD_13=" B "), dict(CLM_ID="2"))
    assert [r[0] for r in df.select(fc.any_equals(df, LINE_STATUS, "B")).collect()] == [True, False]


def test_pairs_inside_and_across_segments(spark, ptp):
    facts = facts_of(
        claims(
            spark,
            dict(CLM_ID="one", HCPCS_CD_1="B", HCPCS_CD_2="A", HCPCS_CD_3="A"),
            dict(CLM_ID="split", HCPCS_CD_1="A"),
            dict(CLM_ID="split", HCPCS_CD_1="B", HCPCS_CD_2="C"),
            dict(CLM_ID="split", HCPCS_CD_1="B"),
            dict(CLM_ID=None, HCPCS_CD_1="A"),
            dict(CLM_ID=None, HCPCS_CD_1="B"),
            dict(CLM_ID="ac", HCPCS_CD_1="A", HCPCS_CD_2="C"),
        )
    )
    pairs = sorted(tuple(r) for r in rl.claim_code_pairs(facts).collect())
    assert pairs == [
        ("ac", "A", "C"), ("one", "A", "B"),
        ("split", "A", "B"), ("split", "A", "C"), ("split", "B", "C"),
    ]
    assert ids(rl.unbundled_claims(facts, ptp)) == ["one", "split"]
    every = rl.canonical_pairs(ptp, with_modifier=False)
    assert sorted(tuple(r) for r in every.collect()) == [("A", "B"), ("A", "C")]
    assert ids(rl.listed_pair_claims(facts, every)) == ["ac", "one", "split"]


def test_stage1_precedence_and_shared_verdict(spark, hcpcs, ptp, links):
    facts = facts_of(
        claims(
            spark,
            dict(CLM_ID="all", HCPCS_CD_1="N", HCPCS_CD_2="A", HCPCS_CD_3="B", HCPCS_CD_4="L"),
            dict(CLM_ID="lcd", HCPCS_CD_1="L", ICD9_DGNS_CD_1=" "),
            dict(CLM_ID="dx", HCPCS_CD_1="L", LINE_ICD9_DGNS_CD_13="4019"),
            # the code sits on one segment, the bare row is the other one
            dict(CLM_ID="seg", HCPCS_CD_1="L", ICD9_DGNS_CD_1="4019"),
            dict(CLM_ID="seg"),
            dict(CLM_ID=None, HCPCS_CD_1="N"),
        )
    )
    out = rl.stage1(facts, hcpcs, ptp, links)
    got = sorted((r.CLM_ID or "", r.stage1_reason_code) for r in out.collect())
    assert got == [
        ("", "NONE"), ("all", "HCPCS_NONCOVERED"), ("dx", "NONE"), ("lcd", "LCD_CONDITION_UNMET"),
        ("seg", "LCD_CONDITION_UNMET"), ("seg", "LCD_CONDITION_UNMET"),
    ]
    gated = lb.gate_pass_through(facts, out)
    assert sorted(r.CLM_ID or "" for r in gated.collect()) == ["", "dx"]


def test_no_diagnosis_trigger_fires_only_on_ungated_claims(spark, hcpcs, ptp, links):
    facts = facts_of(claims(spark, dict(CLM_ID="lcd", HCPCS_CD_1="L")))
    assert ids(lb.soft_no_diagnosis_risk(facts, links)) == ["lcd"]
    gated = lb.gate_pass_through(facts, rl.stage1(facts, hcpcs, ptp, links))
    assert lb.soft_no_diagnosis_risk(gated, links).count() == 0


def test_symptom_trigger_dots_and_weights(spark):
    facts = facts_of(
        claims(
            spark,
            dict(CLM_ID="x", LINE_ICD9_DGNS_CD_1="78650", HCPCS_CD_1="70553", HCPCS_CD_2="27447"),
            dict(CLM_ID="y", LINE_ICD9_DGNS_CD_1="4019", HCPCS_CD_1="27447"),
            dict(CLM_ID="z", LINE_ICD9_DGNS_CD_1="786.50", HCPCS_CD_1="E0601"),
        )
    )
    literal = lb.soft_symptom_risk(facts)
    assert [(r.CLM_ID, r.weight) for r in literal.collect()] == [("z", 0.8)]
    loose = lb.soft_symptom_risk(facts, strip_dots=True)
    assert sorted((r.CLM_ID, r.weight) for r in loose.collect()) == [("x", 1.0), ("z", 0.8)]
    assert len(fc.procedure_weights()) == 30


def test_label_precedence(spark):
    df = spark.createDataFrame(
        [(False, True, True), (True, False, True), (True, False, False), (False, False, False)],
        "a boolean, bc boolean, t boolean",
    )
    got = [r[0] for r in df.select(lb.label(F.col("a"), F.col("bc"), F.col("t"))).collect()]
    assert got == [None, 1, 0, None]


def test_collapse_labels_truth_table(spark):
    rows = [("k1", 1), ("k1", 0), ("k2", 0), ("k2", None), ("k3", None), (None, 1), (None, 0)]
    df = spark.createDataFrame(
        [(k, "p", 1, None, None, None, v) for k, v in rows],
        "CLM_ID string, DESYNPUF_ID string, sample_id int, CLM_FROM_DT string, CLM_THRU_DT string,"
        " CLM_DRG_CD string, is_denied int",
    )
    got = {r.CLM_ID: r.is_denied for r in ft.collapse_labels(df).collect()}
    assert got == {"k1": 1, "k2": 0, "k3": None, None: 1}


def test_dates(spark):
    df = spark.createDataFrame(
        [("19901231", "19910101"), ("19901231", "20081341"), ("x", "19910101")], "b string, s string"
    )
    ages = df.select(
        fc.age_at_claim(F.col("b"), F.col("s")), fc.age_at_claim_serving(F.col("b"), F.col("s"))
    ).collect()
    assert [tuple(r) for r in ages] == [(1, 1), (None, 18), (None, 0)]
    months = df.select(fc.claim_month(F.col("s")), fc.claim_month_serving(F.col("s"))).collect()
    assert [tuple(r) for r in months] == [(1, 1), (None, 0), (1, 1)]


def test_safe_numbers(spark):
    df = spark.createDataFrame([(" 2.9 ",), ("nan",), ("None",), ("",), (None,), ("-3.7",)], "t string")
    got = df.select(fc.safe_double(F.col("t"), -1.0), fc.safe_int(F.col("t"), -1)).collect()
    assert [tuple(r) for r in got] == [(2.9, 2), (-1.0, -1), (-1.0, -1), (-1.0, -1), (-1.0, -1), (-3.7, -3)]


def test_features_keep_row_count_with_repeated_drg_codes(spark):
    facts = facts_of(
        claims(
            spark,
            dict(CLM_ID="1", CLM_DRG_CD="207", CLM_UTLZTN_DAY_CNT="1", HCPCS_CD_1="A"),
            dict(CLM_ID="1", CLM_DRG_CD="207", CLM_UTLZTN_DAY_CNT="20", HCPCS_CD_1="A"),
            dict(CLM_ID="2", DESYNPUF_ID=None),
        )
    )
    labels = facts.select(*ml.CLAIM_KEY).withColumn("is_denied", F.lit(1))
    drg = spark.createDataFrame(
        [("207", 5.0, 7.0), (" 207", 6.0, 4.0), ("208", 1.0, 1.0)], "drg_code string, weight double, alos_hist double"
    )
    bene = spark.createDataFrame(
        [("p", "19500101", "2", "12", "x", "1.5", None, "2", *["1"] * 8)],
        "DESYNPUF_ID string, BENE_BIRTH_DT string, BENE_SEX_IDENT_CD string, BENE_HI_CVRAGE_TOT_MONS string,"
        "BENE_SMI_CVRAGE_TOT_MONS string, MEDREIMB_IP string, MEDREIMB_CAR string, BENRES_CAR string,"
        "SP_DIABETES string, SP_CHF string, SP_CNCR string, SP_COPD string, SP_CHRNKIDN string,"
        "SP_OSTEOPRS string, SP_RA_OA string, SP_STRKETIA string",
    )
    out = ft.build_features(facts, labels, drg, bene)
    rows = sorted(out.collect(), key=lambda r: (r.CLM_ID, r.utilization_days))
    assert [(r.short_stay_flag, r.los_outlier_flag, r.drg_los_reference) for r in rows] == [
        (1, 0, 7.0), (0, 1, 7.0), (0, 0, 0.0),
    ]
    assert (rows[0].bene_age_at_claim, rows[0].chronic_condition_count, rows[2].bene_age_at_claim) == (41, 8, None)
    ml.check_leakage(out)
    with pytest.raises(ml.LeakageError):
        ml.check_leakage(out.withColumn("denial_sources", F.lit("")))


def test_final_join_is_null_safe(spark):
    schema = (
        "CLM_ID string, DESYNPUF_ID string, sample_id int, CLM_FROM_DT string, CLM_THRU_DT string, CLM_DRG_CD string"
    )
    s1 = spark.createDataFrame(
        [("1", "p", 1, "a", None, None, "PASS_TO_ML"), ("2", "p", 1, "a", None, None, "HARD_DENY"), (None, "p", 1, "a", None, None, "PASS_TO_ML")],
        schema + ", stage1_decision string",
    )
    scores = spark.createDataFrame(
        [("1", "p", 1, "a", None, None, 0.2), ("1", "p", 1, "a", None, None, 0.7), ("2", "p", 1, "a", None, None, 0.9), (None, "p", 1, "a", None, None, 0.4)],
        schema + f", {ml.PROBABILITY} double",
    )
    out = ml.final_join(s1, ml.best_score_per_key(scores))
    assert {r.CLM_ID: r[ml.PROBABILITY] for r in out.collect()} == {"1": 0.7, "2": None, None: 0.4}


def test_codes_of_claims_in_one_row_are_dropped_before_they_are_counted(spark):
    """Few claims in several segments: their ids reach the scan, so no other claim's codes are shuffled."""
    df = claims(
        spark, dict(CLM_ID="one", HCPCS_CD_1="A", HCPCS_CD_2="B"), dict(CLM_ID="two", HCPCS_CD_1="A"),
        dict(CLM_ID="two", HCPCS_CD_1="C"), dict(HCPCS_CD_1="A"), dict(HCPCS_CD_1="B"),
    )
    codes = rl._split_claim_codes(facts_of(df))
    assert sorted(map(tuple, codes.collect())) == [("two", "A"), ("two", "C")]
    plan = codes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_segments_lie_by_order_after_two_exchanges(spark):
    """Kinds are counted in one exchange and dealt by order in one more; what is keyed by order needs no third."""
    from driver_queries import adapter as ad

    rows = [(1, "A", None, "x")] * 30 + [(1, "B", "C", None)] * 2 + [(2, "A", None, None)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, code string, ind string, dx string")
    segments = ad.claim_segments(lines)
    assert sorted((r.l_orderkey, r.block, r.segment, len(r.slots)) for r in segments.collect()) == [
        (1, 0, 0, 13), (1, 0, 1, 2), (1, 1, 0, 13), (1, 2, 0, 4), (2, 0, 0, 1),
    ]
    assert _exchanges(segments.groupBy("l_orderkey").count()) == 2


def test_facts_do_not_wait_for_the_wide_claims(spark, tmp_path):
    """Facts come out the same from the stored wide table and, without storing it, from its rows as they are made."""
    from driver_queries import prepared as pt

    frames = {
        "part": spark.createDataFrame([(1, "Brand#1", "PROMO"), (2, "Brand#13", "X")], "p_partkey long, p_brand string, p_type string"),
        "lineitem": spark.createDataFrame(
            [(k, 1 + i % 2, "R" if i % 3 == 0 else "N", "F" if i % 4 else "O", 0.08, 0.1) for k in (1, 2) for i in range(9 * k)],
            "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_tax double, l_discount double",
        ),
        "orders": spark.range(1, 5).selectExpr(
            "id o_orderkey", "id o_custkey", "timestamp'1995-01-01' o_orderdate", "'4-NOT SPECIFIED' o_orderpriority", "'P' o_orderstatus"),
        "customer": spark.range(1, 5).selectExpr("id c_custkey", "cast(id as int) c_nationkey"),
    }
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    for d in (first, second):
        for name, df in frames.items():
            df.write.parquet(f"{d}/{name}.parquet")
    made = sorted(map(repr, pt.facts(spark, first).collect()))
    assert not [k for k in pt._WRITTEN if k[1:] == (first, "claims")]
    assert pt.claims(spark, second).count() == 5
    assert sorted(map(repr, pt.facts(spark, second).collect())) == made


def test_partners_are_looked_for_inside_the_row(spark, ptp):
    """A row of many codes is exploded into its codes, not into its pairs."""
    many = dict(CLM_ID="many", HCPCS_CD_44="A", HCPCS_CD_45=" B", **{f"HCPCS_CD_{i}": f"Z{i}" for i in range(1, 40)})
    df = claims(spark, many, dict(CLM_ID="one", HCPCS_CD_1="A", HCPCS_CD_2="A"), dict(HCPCS_CD_1="A", HCPCS_CD_2="B"))
    hit = rl.listed_pair_claims(facts_of(df), rl.canonical_pairs(ptp))
    assert ids(hit) == ["many"]
    assert "lambdafunction" not in hit._jdf.queryExecution().optimizedPlan().toString()


def test_weights_do_not_move_the_codes(spark):
    """The weights are few and known to be: no code is shuffled to meet them."""
    df = claims(
        spark, dict(CLM_ID="1", HCPCS_CD_1="70553", HCPCS_CD_2="27447", LINE_ICD9_DGNS_CD_1="78650"),
        dict(CLM_ID="2", HCPCS_CD_1="70553", LINE_ICD9_DGNS_CD_1="4019"),
    )
    risk = lb.soft_symptom_risk(facts_of(df), strip_dots=True)
    assert [tuple(r) for r in risk.collect()] == [("1", 1.0, lb.SYMPTOM_SOURCE)]
    plan = risk._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "hashpartitioning(hcpcs_code" not in plan
