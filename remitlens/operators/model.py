"""Stage 2c: split, boosted trees, scoring and the final join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.operators.boosting import GBTClassifier
from remitlens.operators.keys import null_safe
from remitlens.operators.order_statistic import ceil_share, hash_number, kth_smallest
from remitlens.schema import CLAIM_KEY, LABEL_SOURCE_COLUMNS
from remitlens.session import cut_lineage, fresh_path

PROBABILITY = "stage2_denial_probability"
NOT_FEATURES = [*CLAIM_KEY, "is_denied", "side"]


class LeakageError(ValueError):
    pass


def check_leakage(df: DataFrame) -> None:
    """Refuse a table that carries columns the label was derived from."""
    found = sorted(set(LABEL_SOURCE_COLUMNS) & set(df.columns))
    if found:
        raise LeakageError(f"label-source columns in the feature table: {found}")


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def feature_matrix(df: DataFrame, keep: list[str]) -> DataFrame:
    """All features as doubles: booleans as 0/1, unreadable or missing values as 0."""

    def number(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            value = value.cast("int")
        return F.coalesce(value.try_cast("double"), F.lit(0.0)).alias(field.name)

    names = set(feature_names(df)) - set(keep)
    return df.select(*keep, *[number(f) for f in df.schema.fields if f.name in names])


def labelled_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_denied").isNotNull())


def _patient() -> Column:
    return F.coalesce(F.col("DESYNPUF_ID").cast("string"), F.lit(""))


def patient_split(df: DataFrame, test_share: int = 20, seed: str = "") -> DataFrame:
    """``is_train`` by patient: exactly ``test_share`` percent of the patients (rounded up) are test patients.

    Patients go by a hash of their id; those with the largest hashes are the test
    patients. The border is an exact order statistic over the distinct patients (null
    is one), so no patient is on both sides and rows are not joined with patients.
    """
    spread = hash_number(F.concat(F.lit(seed), _patient()))
    patients = df.select(spread.alias("spread")).distinct().withColumn("all", F.lit(0))
    train = F.col("n") - ceil_share(test_share)
    border = kth_smallest(patients, "all", "spread", train).select("cut").scalar()
    return df.withColumn("is_train", F.coalesce(spread <= border, F.lit(False)))


def row_spread() -> Column:
    """The hash that deals rows into training and validation: that of the claim key."""
    shown = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in CLAIM_KEY]
    return hash_number(F.concat_ws("|", F.lit("val"), *shown))


def validation_split(df: DataFrame, val_share: int = 20) -> DataFrame:
    """``is_val``: exactly ``val_share`` percent of the rows of each label (rounded up).

    The rows with the smallest hashes of a label are its validation rows; rows of
    equal claim keys have equal hashes and stay together, so only copies that lie on
    the border make the share larger.
    """
    rows = df.select(F.col("is_denied").alias("stratum"), row_spread().alias("spread"))
    borders = kth_smallest(rows, "stratum", "spread", ceil_share(val_share))
    borders = borders.select(F.col("stratum").alias("border_of"), F.col("cut").alias("border"))
    near = F.col("is_denied").eqNullSafe(F.col("border_of"))
    sided = df.join(borders, near, "left")
    return sided.withColumn("is_val", F.coalesce(row_spread() <= F.col("border"), F.lit(False))).drop("border_of", "border")


def three_sides(df: DataFrame) -> DataFrame:
    """Labelled rows with ``side``: ``train``, ``val`` (both of training patients) or ``test``."""
    sided = cut_lineage(patient_split(df), "sided")
    inner = validation_split(sided.where("is_train"))
    inner = inner.withColumn("side", F.when(F.col("is_val"), "val").otherwise("train")).drop("is_val", "is_train")
    return inner.unionByName(sided.where("not is_train").drop("is_train").withColumn("side", F.lit("test")))


def class_balance(df: DataFrame) -> DataFrame:
    """One row: class counts floored at 1, the positive weight, the positive rate."""
    counts = df.agg(
        F.greatest(F.count_if(F.col("is_denied") == 0), F.lit(1)).alias("negatives"),
        F.greatest(F.count_if(F.col("is_denied") == 1), F.lit(1)).alias("positives"),
        F.avg(F.col("is_denied").cast("double")).alias("positive_rate"),
    )
    return counts.withColumn("positive_weight", F.col("negatives") / F.col("positives"))


@dataclass(frozen=True)
class TreeSettings:
    """Published settings of the reference model; ``min_rows`` counts rows.

    ``patience``: boosting stops after so many trees without a better average
    precision on the validation rows, and the best number of trees is kept; all trees
    are, if it is None.
    """

    trees: int = 400
    depth: int = 5
    step: float = 0.05
    row_share: float = 0.8
    column_share: str = "0.8"
    min_rows: int = 7
    seed: int = 42
    patience: int | None = 40


#: Classes of the probability that spread the scores of one tree over tasks.
SCORE_CLASSES = 1024
#: Rows that one task of the boosting holds at least, and at most.
ROWS_PER_TASK, MOST_ROWS = 25_000, 2_000_000
#: Trees between two checkpoints of the running margins.
CHECKPOINT_TREES = 10


def leaf_values(model) -> list[list[float]]:
    """Per tree its weighted leaf predictions, in the order of the leaf numbers.

    They come from the node table that Spark stores with a model: nodes are numbered
    from the root on, left before right, and so are leaves.
    """
    spark = SparkSession.getActiveSession()
    path = fresh_path(spark, "trees")
    model.write().save(path)
    weights = model.treeWeights
    values: list[list[float]] = [[] for _ in weights]
    nodes = spark.read.parquet(f"{path}/data").where("nodeData.leftChild < 0")
    for r in nodes.select("treeID", "nodeData.id", "nodeData.prediction").orderBy("treeID", "id").collect():
        values[r.treeID].append(weights[r.treeID] * r.prediction)
    return values


def prefix_precisions(assembled: DataFrame, model) -> list[float]:
    """Average precision on ``assembled`` (features, ``is_denied``) after 1, 2, ... trees.

    A row's margins after each tree are the running sums of its leaves' values. They
    are counted per tree and distinct margin (nine decimals, as all scores are compared),
    where the rows lie first, so every figure is exact. The cumulative counts come in
    two levels, within and between classes of the probability; one number per tree
    reaches the driver.
    """
    values = leaf_values(model)
    n, width = len(values), max(map(len, values))
    padded = np.array([v + [0.0] * (width - len(v)) for v in values])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(n)
        for batch in batches:
            leaves = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(leaves), 2048):
                margins = np.round(np.cumsum(padded[tree, leaves[start : start + 2048]], axis=1), 9) + 0.0
                label = labels[start : start + 2048]
                found = [np.unique(margins[:, t], return_inverse=True) for t in range(n)]
                pos = [np.bincount(at, weights=label, minlength=len(m)).astype(np.int64) for m, at in found]
                every = [np.bincount(at, minlength=len(m)) for m, at in found]
                hits = np.concatenate(pos)
                columns = [tree.repeat([len(p) for p in pos]), np.concatenate([m for m, _ in found]), hits, np.concatenate(every) - hits]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "margin", "pos", "neg"])

    leaved = model.copy().setLeafCol("leaves").transform(assembled)
    counts = (
        leaved.select(vector_to_array("leaves").alias("leaves"), F.col("is_denied").cast("bigint"))
        .mapInArrow(count, "tree bigint, margin double, pos bigint, neg bigint")
        .groupBy("tree", "margin")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .withColumn("class", F.floor(SCORE_CLASSES / (1 + F.exp(-2 * F.col("margin")))))
    )
    counts = cut_lineage(counts, "margins")
    above = Window.partitionBy("tree").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("tree", "class").agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("rows"))
    classes = classes.select(
        "tree", "class",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("rows_above"),
        F.sum("pos").over(Window.partitionBy("tree")).alias("all_pos"),
    )
    down = Window.partitionBy("tree", "class").orderBy(F.desc("margin"))
    placed = counts.join(classes, ["tree", "class"])
    hits = F.sum("pos").over(down) + F.col("pos_above")
    flagged = F.sum(F.col("pos") + F.col("neg")).over(down) + F.col("rows_above")
    gain = F.coalesce(F.try_divide("pos", "all_pos"), F.lit(0.0))
    parts = placed.select("tree", (gain * hits / flagged).alias("part"))
    by_tree = dict(parts.groupBy("tree").agg(F.sum("part")).collect())
    return [by_tree.get(t, 0.0) for t in range(n)]


def best_prefix(precisions: list[float], patience: int) -> tuple[int, bool]:
    """(trees to keep, whether patience has run out): the first best, seen within patience."""
    best = 0
    for k, value in enumerate(precisions):
        if value > precisions[best] + 1e-12:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, keep: int) -> GBTClassificationModel:
    """The ensemble of the first ``keep`` trees of a fitted one; boosting adds trees one after the other."""
    jvm = SparkContext._active_spark_context._jvm
    own = model._java_obj
    trees = SparkContext._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, keep)
    weights = SparkContext._gateway.new_array(jvm.double, keep)
    fitted, weighted = own.trees(), own.treeWeights()
    for k in range(keep):
        trees[k], weights[k] = fitted[k], weighted[k]
    kept = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        own.uid(), trees, weights, own.numFeatures(), own.numClasses()
    )
    return GBTClassificationModel(kept)


def boosting_tasks(rows: int, slots: int) -> int:
    """Every level of every tree is a job over all partitions, so there are as many as run at
    once, or fewer for few rows; beyond ``MOST_ROWS`` a task, a whole number of rounds."""
    rounds = -(-rows // (slots * MOST_ROWS))
    return max(1, min(-(-rows // ROWS_PER_TASK), slots * rounds))


def train_gbt(features: DataFrame, settings: TreeSettings = TreeSettings()) -> PipelineModel:
    """Fit on the training patients. The input is stored once, because boosting
    reads it for every tree.

    The ensemble is fitted once, with all trees asked for; what patience leaves of it
    are its first trees. Boosting keeps the margins of all rows from tree to tree; they
    are checkpointed in the shared folder, so their lineage stays short.
    """
    check_leakage(features)
    names = feature_names(features)
    labelled = labelled_only(features)
    if labelled.isEmpty():
        raise ValueError("no labelled rows to train on")
    inner = three_sides(labelled).where("side <> 'test'")
    prepared = cut_lineage(feature_matrix(inner, keep=["side", "is_denied"]), "train")
    balance = class_balance(prepared.where("side = 'train'"))
    weight = balance.select("positive_weight").scalar()
    counted = balance.select(F.col("negatives") + F.col("positives")).first()[0]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    weighted = cut_lineage(
        assembler.transform(prepared).select(
            "features",
            "is_denied",
            "side",
            F.col("is_denied").cast("double").alias("label"),
            F.when(F.col("is_denied") == 1, weight).otherwise(1.0).alias("row_weight"),
        ),
        "weighted",
    )
    context = features.sparkSession.sparkContext
    fitted_on = weighted.where("side = 'train'").repartition(boosting_tasks(counted, context.defaultParallelism))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(fresh_path(features.sparkSession, "boosting"))
    model = GBTClassifier(
        maxIter=settings.trees,
        maxDepth=settings.depth,
        stepSize=settings.step,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=settings.column_share,
        minInstancesPerNode=settings.min_rows,
        checkpointInterval=CHECKPOINT_TREES,
        weightCol="row_weight",
        seed=settings.seed,
    ).fit(fitted_on)
    if settings.patience is not None:
        keep, _ = best_prefix(prefix_precisions(weighted.where("side = 'val'"), model), settings.patience)
        if keep < model.getNumTrees:
            model = first_trees(model, keep)
    return PipelineModel(stages=[assembler, model])


def model_inputs(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus the denial probability, for labelled and unlabelled rows."""
    names = model_inputs(model)
    have = set(df.columns)
    numbers = {
        n: F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)
        for n in names
    }
    packed = df.withColumns({f"x_{n}": c for n, c in numbers.items()})
    ready = packed.select(*keep, *[F.col(f"x_{n}").alias(n) for n in names if n not in keep])
    return model.transform(ready).select(
        *keep, vector_to_array("probability")[1].alias(PROBABILITY)
    )


def best_score_per_key(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*CLAIM_KEY).agg(F.max(PROBABILITY).alias(PROBABILITY))


def final_join(stage1: DataFrame, scores: DataFrame) -> DataFrame:
    """Stage 1 rows with their probability; convicted claims have none."""
    joined = stage1.join(scores, null_safe(stage1, scores, CLAIM_KEY), "left")
    return joined.select(
        *[stage1[c] for c in stage1.columns],
        F.when(stage1["stage1_decision"] != "HARD_DENY", scores[PROBABILITY]).alias(PROBABILITY),
    )
