"""The batch run over a claims table: rule tables, verdicts, labels, features,
model, report and joined results. Stages hand over by Parquet under ``out``, so a
lost executor or a restart costs one stage at most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.operators import evaluate as ev
from remitlens.operators import features as ft
from remitlens.operators import labels as lb
from remitlens.operators import model as ml
from remitlens.operators import reports as rp
from remitlens.operators import rules as rl
from remitlens.operators.model import TreeSettings
from remitlens.schema import CLAIM_KEY
from remitlens.sinks import tables as tb
from remitlens.sources import claims as sc
from remitlens.sources import rule_files as rf


@dataclass(frozen=True)
class RuleFiles:
    hcpcs: str
    mue: str
    ptp: str
    drg_history: str
    drg_folder: str
    articles: str


def _store(df: DataFrame, path: str) -> DataFrame:
    tb.write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_rule_tables(spark: SparkSession, files: RuleFiles, out: str) -> dict[str, DataFrame]:
    tables = {
        "hcpcs": rf.read_hcpcs(spark, files.hcpcs),
        "mue": rf.read_mue(spark, files.mue),
        "ptp": rf.read_ptp(spark, files.ptp),
        "drg": rf.merge_drg(
            rf.read_drg_history(spark, files.drg_history),
            rf.read_drg_table5(spark, files.drg_folder),
        ),
        "article_hcpcs": rf.read_article_hcpcs(spark, f"{files.articles}/article_x_hcpc_code.csv"),
        "icd10_covered": rf.read_article_icd10(
            spark, f"{files.articles}/article_x_icd10_covered.csv"
        ),
        "icd10_noncovered": rf.read_article_icd10(
            spark, f"{files.articles}/article_x_icd10_noncovered.csv"
        ),
    }
    return {name: _store(df, f"{out}/rules/{name}") for name, df in tables.items()}


def run_stage1(
    spark: SparkSession, claims: DataFrame, rules: dict[str, DataFrame], out: str
) -> tuple[DataFrame, DataFrame]:
    """(claim facts, verdicts)"""
    facts = _store(rl.fold_claims(claims), f"{out}/claim_facts")
    verdicts = _store(
        rl.stage1(facts, rules["hcpcs"], rules["ptp"], rules["article_hcpcs"]), f"{out}/stage1"
    )
    tb.write_summary(
        rp.rule_summary(verdicts), f"{out}/stage1_rule_summary",
        [F.desc("claim_count"), "stage1_reason_code"],
    )
    tb.write_summary(
        rp.stage1_validation(verdicts), f"{out}/stage1_validation",
        [F.desc("claim_count"), "stage1_reason_code"],
    )
    return facts, verdicts


def run_labels(
    facts: DataFrame, verdicts: DataFrame, rules: dict[str, DataFrame], out: str,
    strip_dots: bool = False,
) -> DataFrame:
    gated = _store(lb.gate_pass_through(facts, verdicts), f"{out}/passed_facts")
    triggers = lb.all_triggers(
        gated, rules["ptp"], rules["article_hcpcs"], rules["drg"], strip_dots
    )
    labels = _store(
        lb.train_labels(gated, lb.claim_risk_summary(triggers)), f"{out}/train_labels"
    )
    tb.write_summary(
        rp.label_summary(labels), f"{out}/label_summary",
        [F.desc("claim_count"), "is_denied", "denial_sources"],
    )
    return labels


def run_features(
    facts: DataFrame, labels: DataFrame, drg: DataFrame, bene: DataFrame, out: str,
    weight_scale: float = 1.0,
) -> DataFrame:
    features = _store(
        ft.build_features(facts, labels, drg, bene, weight_scale), f"{out}/features"
    )
    tb.write_summary(rp.feature_summary(features), f"{out}/feature_summary")
    return features


def run_training(
    features: DataFrame, out: str, settings: TreeSettings = TreeSettings(), sample_id: int = 1
):
    """(model, metrics): fitted on the training patients, measured on the others."""
    model = ml.train_gbt(features, settings)
    tb.write_model(model, f"{out}/model")
    sided = ml.three_sides(ml.labelled_only(features))
    test = sided.where("side = 'test'")
    scored = _store(
        ml.score(model, test, ["is_denied"]).select(
            F.col("is_denied").alias("label"), F.col(ml.PROBABILITY).alias("score")
        ),
        f"{out}/test_scores",
    )
    sizes = sided.agg(
        F.lit(sample_id).alias("sample_id"),
        F.count("*").alias("rows_total"),
        F.lit(features.count()).alias("rows_all_features"),
        F.count_if(F.col("side") == "train").alias("rows_train"),
        F.count_if(F.col("side") == "val").alias("rows_val"),
        F.count_if(F.col("side") == "test").alias("rows_test"),
        F.avg("is_denied").alias("positive_rate"),
    )
    counts = ev.score_counts(scored)
    metrics = _store(ev.metrics_row(counts, sizes), f"{out}/metrics_table")
    operating = ev.operating_table(counts, metrics)
    tb.write_metrics(metrics, operating, f"{out}/metrics")
    return model, metrics, operating


def run_all(
    spark: SparkSession,
    claims_path: str,
    beneficiaries_path: str,
    files: RuleFiles,
    out: str,
    sample_id: int,
    max_claims: int | None = None,
    settings: TreeSettings = TreeSettings(),
    strip_dots: bool = False,
) -> DataFrame:
    """All stages for one sample; returns Stage 1 joined with the probabilities."""
    rules = load_rule_tables(spark, files, out)
    claims = sc.scan_claims(spark, claims_path, sample_id, max_claims)
    bene = sc.scan_beneficiaries(spark, beneficiaries_path)
    facts, verdicts = run_stage1(spark, claims, rules, out)
    labels = run_labels(facts, verdicts, rules, out, strip_dots)
    features = run_features(facts, labels, rules["drg"], bene, out)
    model, metrics, operating = run_training(features, out, settings, sample_id)
    tb.write_report(
        rp.markdown_report(verdicts, metrics, operating, labels, sample_id), f"{out}/report"
    )
    scores = ml.best_score_per_key(ml.score(model, features, CLAIM_KEY))
    return _store(ml.final_join(verdicts, scores), f"{out}/results")
