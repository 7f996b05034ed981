"""Call phases, summaries, request admission and their streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from remitlens.operators import calls as ca
from remitlens.operators import requests as rq
from remitlens.streaming import calls as sca


def run(spark, flow, *lines):
    turns = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "call_id long, turn long, payer string")
    return [r.state for r in ca.call_phases(turns, flow).orderBy("turn").collect()]


def test_status_call(spark):
    assert run(
        spark, ca.STATUS_CALL, "Please enter your NPI", "claim control number", "status:  denied", "press 0",
        "how can i help",
    ) == ["IVR_AUTH_NPI", "IVR_CLAIM_LOOKUP", "IVR_STATUS_CODES", "TRANSFER_TO_REP", "REP_DETAIL"]
    assert run(spark, ca.STATUS_CALL, "npi", "claim denied") == ["IVR_AUTH_NPI", "IVR_CLAIM_LOOKUP"]
    assert run(spark, ca.STATUS_CALL, "npi", "goodbye", "npi") == ["IVR_AUTH_NPI", "CALL_CLOSE", "CALL_CLOSE"]
    # the skip-ahead rule looks at the phase held before the turn
    assert run(spark, ca.STATUS_CALL, "npi transfer") == ["TRANSFER_TO_REP"]


def test_appeal_call(spark):
    assert run(
        spark, ca.APPEAL_CALL, "authenticate", "press 0", "fax receipt", "clinical documents", "tracking number",
        "30 day timeline", "that will be all",
    ) == [
        "IVR_AUTH_NPI", "TRANSFER_TO_REP", "REP_CONFIRM_RECEIPT", "REP_CLINICAL_REVIEW", "REP_TRACKING",
        "REP_TIMELINE", "CALL_CLOSE",
    ]


def replay(flow, lines):
    """Turn by turn, straight from the flow's definition."""
    state, out = flow.phases[0], []
    for line in lines:
        before = state
        for step in flow.steps:
            if (not step.sources or before in step.sources) and re.search(step.pattern, line):
                state = step.to
                break
        for step in flow.overrides:
            if (not step.sources or before in step.sources) and re.search(step.pattern, line):
                state = step.to
        out.append(state)
    return out


WORDS = ["npi", "claim", "denied", "press 0", "how can i help", "document", "reference", "that is all", "hm", "speak to rep"]


@pytest.mark.parametrize("block, levels", [(2, 2), (3, 1), (512, 2), (4, 0)])
def test_blocks_give_the_same_phases(spark, block, levels):
    rng = random.Random(block)
    calls = {c: [rng.choice(WORDS) for _ in range(rng.randint(1, 40))] for c in range(5)}
    turns = spark.createDataFrame(
        [(c, i, t) for c, lines in calls.items() for i, t in enumerate(lines)], "call_id long, turn long, payer string"
    )
    flow = ca.STATUS_CALL
    maps = ca.turn_maps(turns, flow).select("call_id", F.col("turn").alias("pos"), "map")
    got = ca.prefix_phases(maps, len(flow.phases), block, levels).orderBy("call_id", "pos").collect()
    for c, lines in calls.items():
        states = [flow.phases[r["after"] - 1] for r in got if r.call_id == c]
        assert states == replay(flow, lines)


def test_summary_last_rule_wins_and_state_labels_count(spark):
    log = spark.createDataFrame(
        [(1, 0, "IVR_GREETING", "denied", "x"), (1, 1, "REP_REFERENCE", "paid carc", None), (2, 0, "IVR_GREETING", "hi", "yo")],
        "call_id long, turn long, state string, payer string, provider string",
    )
    rows = {r.call_id: r for r in ca.call_summary(log).collect()}
    assert rows[1].status_case == "approved" and rows[1].current_state == "REP_REFERENCE"
    assert rows[1].missing_information == [
        "Confirm RARC denial code", "Confirm required supporting documentation list",
    ]
    assert rows[2].status_case == "in_progress" and len(rows[2].missing_information) == 4
    assert rows[1].recent == "PAYER: denied\nPROVIDER: x\nPAYER: paid carc\nPROVIDER: "


def test_prior_context_over_block_borders(spark):
    log = spark.createDataFrame(
        [(1, i, f"p{i}", f"r{i}") for i in range(11)], "call_id long, turn long, payer string, provider string"
    )
    rows = ca.prior_context(log, n=3, block=4).orderBy("turn").collect()
    for r in rows:
        want = "\n".join(f"PAYER: p{i}\nPROVIDER: r{i}" for i in range(max(0, r.turn - 3), r.turn))
        assert r.prior == want


def test_prompt_hides_internal_keys(spark):
    row = spark.createDataFrame(
        [(1, 0, "IVR_GREETING", "hello", "", {"claim_id": "7", "denial_source": "x", "classifier": "y"}, None)],
        "call_id long, turn long, state string, payer string, prior string, context map<string,string>, policy_excerpts string",
    )
    prompt = ca.prompt_rows(row, ca.STATUS_CALL).first().prompt
    assert '{"claim_id":"7"}' in prompt and "denial_source" not in prompt
    assert "[Call Phase: IVR_GREETING]" in prompt and "No policy excerpts" in prompt


def test_scenario(spark):
    df = spark.createDataFrame([(" 3 ",), ("2",), ("9",), (None,)], "s string")
    assert [r[0] for r in df.select(ca.normalise_scenario(F.col("s"))).collect()] == ["3", "2", "2", "2"]


def log_of(spark, times):
    rows = [(c, i, t) for i, (c, t) in enumerate(times)]
    return spark.createDataFrame(rows, "client long, request_id long, us long").select(
        "client", "request_id", F.timestamp_micros("us").alias("ts")
    )


def test_admission_and_demand_against_direct_replay(spark):
    rng = random.Random(3)
    times = [(1, rng.randrange(0, 400_000_000)) for _ in range(200)]
    times += [(2, rng.randrange(0, 4_000_000_000)) for _ in range(100)] + [(3, 5)] * 9
    log = log_of(spark, times)
    got = {r.request_id: r.admitted for r in rq.admission(log, 10, 3).collect()}
    demand = {r.request_id: r.demand for r in rq.trailing_demand(log, 10).collect()}
    for client in (1, 2, 3):
        own = sorted((t, i) for i, (c, t) in enumerate(times) if c == client)
        held = []
        for t, i in own:
            held = [h for h in held if h >= t - 10_000_000]
            assert got[i] == (len(held) < 3)
            if got[i]:
                held.append(t)
            assert demand[i] == sum(t - 10_000_000 <= u <= t for u, _ in own)


def test_stream_releases_turns_in_order(spark, tmp_path):
    lines = ["npi", "claim", "denied", "press 0", "how can i help"]
    source = str(tmp_path / "in")
    schema = "call_id long, turn long, payer string"
    for turn in (2, 0, 4, 1, 3, 1):  # out of order, one turn twice
        spark.createDataFrame([(1, turn, lines[turn])], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        sca.call_phase_stream(stream, ca.STATUS_CALL, patience_ms=None)
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = sca.phases_of(spark.read.parquet(str(tmp_path / "out")), ca.STATUS_CALL).orderBy("turn").collect()
    decided = [(r.turn, r.state) for r in rows if not r.late]
    assert decided == list(enumerate(replay(ca.STATUS_CALL, lines)))
    # the repeated turn is shown as late, not lost
    assert [(r.turn, r.state) for r in rows if r.late] == [(1, None)]
