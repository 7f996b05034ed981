"""Arriving claim rows: Stage 1 verdicts and denial probabilities."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from remitlens.operators import model as ml
from remitlens.operators import rules
from remitlens.schema import CLAIM_KEY
from remitlens.session import cut_lineage

#: Code sightings a task holds before it passes them on.
THINNED = 100_000
FLAGS = ("rule_hcpcs_noncovered", "rule_ptp_unbundling", "rule_lcd_condition_unmet")
#: Groups of claims that share a state. A group costs far more than its claims, so a few hundred
#: claims a group are well; the number must stay the same as long as a checkpoint is used.
GROUPS = 1 << 14
STATE = "claims string"


def arriving(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _sightings(facts: DataFrame) -> DataFrame:
    """(CLM_ID, hcpcs_code, bare): codes and rows without diagnosis per claim, each once per task
    and some 100,000, so a claim with very many rows sends little to its state."""
    schema = "CLM_ID string, hcpcs_code string, bare boolean"

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(seen: set) -> pa.RecordBatch:
            claims, codes, bare = zip(*seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(claims, pa.string()), pa.array(codes, pa.string()), pa.array(bare, pa.bool_())],
                names=["CLM_ID", "hcpcs_code", "bare"],
            )

        seen: set[tuple] = set()
        for batch in batches:
            for claim, codes, bare in zip(*(c.to_pylist() for c in batch.columns)):
                seen.update((claim, code, False) for code in codes or () if code is not None)
                if bare:
                    seen.add((claim, None, True))
                if len(seen) >= THINNED:
                    yield sent(seen)
                    seen = set()
        if seen:
            yield sent(seen)

    bare = (F.col("header_dx_count") == 0) & (F.col("line_dx_count") == 0)
    rows = facts.where(F.col("CLM_ID").isNotNull()).select(
        F.col("CLM_ID").cast("string"), "codes", F.coalesce(bare, F.lit(False)).alias("bare")
    )
    return rows.mapInArrow(thin, schema)


def _convict(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold what arrived into the claims of a group; a row for each that a rule convicts for the first time."""
    held = {c: (codes, *flags) for c, codes, *flags in json.loads(state.get[0])} if state.exists else {}
    before: dict[str, tuple] = {}
    for batch in batches:
        # plain values cost less than a frame's own operations
        columns = [batch[c].values for c in ("CLM_ID", "hcpcs_code", "noncovered", "linked", "bare", "partners")]
        for claim, code, covers_not, links, is_bare, partners in zip(*columns):
            codes, noncovered, linked, bare, unbundled = held.get(claim, ([], False, False, False, False))
            before.setdefault(claim, (noncovered, unbundled, linked and bare))
            if not unbundled and len(partners):
                unbundled = not set(codes).isdisjoint(partners)
                # an unbundled claim stays one, whatever codes follow
                codes = [] if unbundled else codes if code in codes else [*codes, code]
            held[claim] = (codes, noncovered or bool(covers_not), linked or bool(links), bare or bool(is_bare), unbundled)
    state.update((json.dumps([(c, *v) for c, v in held.items()]),))
    now = {c: (held[c][1], held[c][4], held[c][2] and held[c][3]) for c in before}
    found = [(c, *now[c]) for c in before if now[c] != before[c]]
    if found:
        yield pd.DataFrame(found, columns=["CLM_ID", *FLAGS])


def stream_stage1(
    facts: DataFrame,
    hcpcs: DataFrame,
    ptp: DataFrame,
    links: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Judge arriving claim rows with the batch rules.

    A claim's segments may arrive in different batches. Spark's state holds per claim what
    the rules need of the rows so far: the codes that stand in a listed pair and
    four flags, never the rows; claims are held in ``groups`` by a hash of their id. A batch reads
    nothing of its history but the states of the groups it has claims of. Rows go to ``out``
    as they arrive, a conviction goes there when a rule first finds it; convictions are
    never taken back. ``latest_verdicts`` puts the two together.
    """
    static = cut_lineage(rules.code_rules(hcpcs, ptp, links), "code-rules")
    no = F.lit(False)
    known = _sightings(facts).join(static, "hcpcs_code", "left").select(
        "CLM_ID", "hcpcs_code", "bare",
        F.coalesce("noncovered", no).alias("noncovered"),
        F.coalesce("linked", no).alias("linked"),
        F.coalesce("partners", F.array().cast("array<string>")).alias("partners"),
    )
    useful = known.where(F.col("bare") | F.col("noncovered") | F.col("linked") | (F.size("partners") > 0))
    schema = ", ".join(["CLM_ID string", *[f"{f} boolean" for f in FLAGS]])
    grouped = useful.withColumn("group", F.pmod(F.xxhash64("CLM_ID"), F.lit(groups)))
    found = grouped.groupBy("group").applyInPandasWithState(
        _convict, schema, STATE, "append", GroupStateTimeout.NoTimeout
    )
    rows = facts.select(*CLAIM_KEY, "seen_b", "seen_c", F.lit("row").alias("kind"))
    both = rows.unionByName(found.withColumn("kind", F.lit("conviction")), allowMissingColumns=True)
    return (
        both.writeStream.format("parquet")
        .option("path", out)
        .partitionBy("kind")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """All rows that ``stream_stage1`` has seen, each with the verdict of its claim as it stands."""
    every = spark.read.parquet(out)
    hits = every.where("kind = 'conviction'").groupBy("CLM_ID").agg(*[F.bool_or(f).alias(f) for f in FLAGS])
    return rules.judged(every.where("kind = 'row'"), hits)


def stream_score(
    model: PipelineModel,
    features: DataFrame,
    keep: list[str],
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scoring holds no state: the model transforms the stream itself."""
    return (
        ml.score(model, features, keep)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
