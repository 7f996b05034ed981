"""Boosted trees: how many are kept, what they predict, exact splits, and what the training refuses."""

import math
import random

import pytest
from pyspark.sql import functions as F

from remitlens.operators import evaluate as ev
from remitlens.operators import model as ml
from remitlens.operators import order_statistic as osn
from remitlens.session import fresh_path

KIND = (
    "CLM_ID string, DESYNPUF_ID string, sample_id int, CLM_FROM_DT string, CLM_THRU_DT string, CLM_DRG_CD string, "
    "a double, b double, c double, is_denied int"
)


def features(spark, n, labelled=True):
    """Rows whose label depends on three features with some noise."""
    rng, rows = random.Random(5), []
    for i in range(n):
        a, b, c = rng.random(), rng.randint(0, 9), rng.random()
        odds = 4 * a + 0.4 * b - 3 * a * c - 2.2 + rng.gauss(0, 0.8)
        rows.append((str(i), f"p{i % 211}", 1, "20080101", "20080102", None, a, float(b), c, int(odds > 0) if labelled else None))
    return spark.createDataFrame(rows, KIND).coalesce(1)


def plain_precision(pairs):
    """Average precision of (label, score) pairs, equal scores together."""
    total, hits, flagged, out = sum(y for y, _ in pairs), 0, 0, 0.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        here = [y for y, t in pairs if t == s]
        hits, flagged = hits + sum(here), flagged + len(here)
        out += sum(here) / total * hits / flagged
    return out


def plain_margins(spark, model, rows):
    """Running margins of feature vectors, by walking the stored nodes of every tree."""
    path = fresh_path(spark, "walked")
    model.write().save(path)
    trees = [{} for _ in model.treeWeights]
    for r in spark.read.parquet(f"{path}/data").collect():
        trees[r.treeID][r.nodeData.id] = r.nodeData
    out = []
    for x in rows:
        margin, running = 0.0, []
        for tree, weight in zip(trees, model.treeWeights):
            node = tree[0]
            while node.leftChild >= 0:
                goes_left = x[node.split.featureIndex] <= node.split.leftCategoriesOrThreshold[0]
                node = tree[node.leftChild if goes_left else node.rightChild]
            margin += weight * node.prediction
            running.append(margin)
        out.append(running)
    return out


def test_patience():
    rising = [0.1 * k for k in range(10)]
    assert ml.best_prefix(rising, 3) == (10, False)
    assert ml.best_prefix([*rising, 0.5, 0.5, 0.5, 0.99], 3) == (10, True)
    assert ml.best_prefix([*rising, 0.5, 0.5, 0.99], 3) == (13, False)
    assert ml.best_prefix([0.5, 0.5], 40) == (1, False)


def test_learnable_data_keep_many_trees(spark):
    data = features(spark, 1500)
    model = ml.train_gbt(data, ml.TreeSettings(trees=60, depth=3))
    assert 10 <= model.stages[-1].getNumTrees <= 60
    test = ml.three_sides(data).where("side = 'test'")
    scored = ml.score(model, test, ["is_denied"]).select(
        F.col("is_denied").alias("label"), F.col(ml.PROBABILITY).alias("score")
    )
    counts = ev.score_counts(scored)
    quality = ev.metrics_row(counts, ev.row_sizes(counts)).first()
    assert quality.pr_auc > quality.positive_rate + 0.2
    assembled = model.stages[0].transform(test)
    precisions = ml.prefix_precisions(assembled, model.stages[-1])
    assert len(precisions) == model.stages[-1].getNumTrees
    assert precisions[-1] == pytest.approx(quality.pr_auc, abs=1e-9)


def test_every_prefix_of_a_fit_against_plain_code(spark):
    data = features(spark, 800)
    whole = ml.train_gbt(data, ml.TreeSettings(trees=25, depth=3, patience=None))
    boosted = whole.stages[-1]
    assert boosted.getNumTrees == 25
    test = ml.three_sides(data).where("side = 'test'")
    rows = test.select("a", "b", "c", "is_denied", "CLM_ID").collect()
    names = ml.model_inputs(whole)
    margins = plain_margins(spark, boosted, [[r[n] for n in names] for r in rows])
    wanted = [plain_precision([(r.is_denied, round(m[k], 9)) for r, m in zip(rows, margins)]) for k in range(25)]
    got = ml.prefix_precisions(whole.stages[0].transform(test), boosted)
    assert got == pytest.approx(wanted, abs=1e-12)
    # an ensemble of the first trees predicts what the running margin says, stored or not
    first = ml.first_trees(boosted, 9)
    path = fresh_path(spark, "first")
    first.write().save(path)
    for kept in (first, type(first).load(path)):
        assert kept.getNumTrees == 9 and kept.numFeatures == 3
        scored = ml.score(ml.PipelineModel(stages=[whole.stages[0], kept]), test, ["CLM_ID"])
        found = {r.CLM_ID: r[ml.PROBABILITY] for r in scored.collect()}
        for r, m in zip(rows, margins):
            assert found[r.CLM_ID] == pytest.approx(1 / (1 + math.exp(-2 * m[8])), abs=1e-9)


def test_patience_keeps_the_first_trees_of_the_same_fit(spark):
    data = features(spark, 800)
    settings = {"trees": 30, "depth": 3}
    whole = ml.train_gbt(data, ml.TreeSettings(**settings, patience=None)).stages[-1]
    kept = ml.train_gbt(data, ml.TreeSettings(**settings, patience=2)).stages[-1]
    n = kept.getNumTrees
    assert 1 <= n < 30
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:n]]


def test_unlabelled_rows_are_refused(spark):
    with pytest.raises(ValueError, match="no labelled rows"):
        ml.train_gbt(features(spark, 20, labelled=False))


@pytest.mark.parametrize("k", [1, 2, 37, 400, 600])
def test_kth_smallest(spark, k):
    rng = random.Random(k)
    # one stratum with most of the rows, ties, neighbours that differ in the last bit, the largest value
    rows = [("hot", rng.choice([rng.randrange(1 << 60), 5, 6, (1 << 60) - 1])) for _ in range(600)]
    rows += [(None, v) for v in (9, 3, 7)] + [("one", 1 << 59)]
    df = spark.createDataFrame(rows, "s string, v long")
    got = {r.s: r.cut for r in osn.kth_smallest(df, "s", "v", F.least(F.lit(k), F.col("n"))).collect()}
    want = {}
    for s in ("hot", None, "one"):
        values = sorted(v for t, v in rows if t == s)
        want[s] = values[min(k, len(values)) - 1]
    assert got == want
    assert osn.kth_smallest(df, "s", "v", F.lit(0)).count() == 0
    assert osn.kth_smallest(df.where("false"), "s", "v", F.lit(1)).count() == 0


@pytest.mark.parametrize("patients, n", [(1, 4), (7, 61), (211, 1003)])
def test_shares_are_exact(spark, patients, n):
    rows = [(str(i), None if i % patients == 0 else f"p{i % patients}", 1, "20080101", None, None, 0.0, 0.0, 0.0, int(i % 9 == 0)) for i in range(n)]
    sided = ml.three_sides(spark.createDataFrame(rows, KIND)).collect()
    assert len(sided) == n
    by_patient = {}
    for r in sided:
        by_patient.setdefault(r.DESYNPUF_ID, set()).add(r.side == "test")
    assert all(len(v) == 1 for v in by_patient.values())
    assert sum(v == {True} for v in by_patient.values()) == -(-patients // 5)
    for label in (0, 1):
        inner = [r.side for r in sided if r.side != "test" and r.is_denied == label]
        assert inner.count("val") == -(-len(inner) // 5)


def test_boosting_runs_in_as_many_tasks_as_there_are_slots(spark, monkeypatch):
    """Every level of every tree is a job, so its tasks are not a number of rows each but one a slot."""
    assert [ml.boosting_tasks(n, 12) for n in (0, 1, 25_001, 300_000, 3_500_000)] == [1, 1, 2, 12, 12]
    assert [ml.boosting_tasks(n * ml.MOST_ROWS, 12) for n in (12, 13, 25)] == [12, 24, 36]
    monkeypatch.setattr(ml, "ROWS_PER_TASK", 10)
    used = []
    fit = ml.GBTClassifier.fit
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda self, df: used.append(df.rdd.getNumPartitions()) or fit(self, df))
    ml.train_gbt(features(spark, 400), ml.TreeSettings(trees=2, patience=None))
    assert used == [spark.sparkContext.defaultParallelism]
