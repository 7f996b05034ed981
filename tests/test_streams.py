"""Streams with late rows, ids of other types and claims over several batches."""

import random

import numpy as np
from pyspark.sql import functions as F

from driver_queries import calls as dc
from remitlens.operators import calls as ca
from remitlens.operators import requests as rq
from remitlens.operators import rules as rl
from remitlens.streaming import calls as sca
from remitlens.streaming import claims as scl
from remitlens.streaming import requests as srq


def run(stream, tmp_path, name):
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / name)).collect()


def phases(stream, tmp_path, name):
    run(stream, tmp_path, name)
    return sca.phases_of(stream.sparkSession.read.parquet(str(tmp_path / name)), ca.STATUS_CALL).collect()


def files(spark, tmp_path, schema, *batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_requests_with_text_clients_and_late_rows(spark, tmp_path):
    schema = "client string, request_id string, at long"
    batches = [
        [("10.0.0.1", "a", 100), ("10.0.0.1", "b", 101), ("10.0.0.2", "c", 50)],
        [("10.0.0.1", "d", 99), ("10.0.0.1", "f", 103), ("10.0.0.1", "e", 102)],
        [("10.0.0.1", "g", 300), ("10.0.0.2", "h", 10)],
    ]
    stream = files(spark, tmp_path, schema, *batches).withColumn("ts", F.timestamp_seconds("at"))
    rows = run(srq.admission_stream(stream, seconds=60, limit=3), tmp_path, "out")
    assert len(rows) == 8
    assert {r.request_id for r in rows if r.late} == {"d", "h"}
    verdicts = {r.request_id: r.admitted for r in rows if not r.late}
    times = {i: t for batch in batches for c, i, t in batch if c == "10.0.0.1" and i != "d"}
    order = sorted(times, key=times.get)
    want = dict(zip(order, rq.admit([times[i] * 1_000_000 for i in order], 60, 3)))
    assert verdicts == {**want, "c": True} and not want["f"] and want["g"]


def test_calls_with_text_ids_and_a_gap_that_never_fills(spark, tmp_path):
    schema = "call_id string, turn long, payer string"
    stream = files(
        spark, tmp_path, schema, [("x-1", 0, "npi")], [("x-1", t, "claim") for t in range(5, 9)], [("x-1", 2, "claim")]
    )
    rows = phases(sca.call_phase_stream(stream, ca.STATUS_CALL, patience_ms=None, most_runs=0), tmp_path, "out")
    assert sorted((r.call_id, r.turn, r.late) for r in rows) == [
        ("x-1", 0, False), ("x-1", 2, True), *(("x-1", t, False) for t in range(5, 9))
    ]


def test_turns_that_follow_on_do_not_count_as_waiting(spark, tmp_path):
    """Only the turn behind the gap waits, so the gap may still fill."""
    stream = files(
        spark, tmp_path, "call_id long, turn long, payer string",
        [(1, t, "npi") for t in range(8)] + [(1, 9, "claim")], [(1, 8, "status")],
    )
    rows = phases(sca.call_phase_stream(stream, ca.STATUS_CALL, patience_ms=None, most_runs=1), tmp_path, "out")
    assert sorted((r.turn, r.late) for r in rows) == [(t, False) for t in range(10)]


def test_a_hot_call_whose_odd_turns_come_first(spark, tmp_path, monkeypatch):
    """The registered query gives every turn of a call of 24,000 turns the phase of the batch."""
    words = ["tion", "thwh", "plain", "ingthe", "esan"]
    turns = spark.createDataFrame(
        [(7, t, words[t % 5], "") for t in range(24_000)] + [(8, 0, "tion", "")],
        "call_id long, turn int, payer string, provider string",
    )
    monkeypatch.setattr(dc, "turns", lambda *_: turns)
    got = {(r.call_id, r.turn): r.state for r in dc.QUERIES["stream_call_phase"](spark, "").collect()}
    assert got == {(r.call_id, r.turn): r.state for r in ca.call_phases(turns, dc.FLOW_A).collect()}
    assert len(got) == 24_001 and None not in got.values()


FACTS = (
    "CLM_ID string, DESYNPUF_ID string, sample_id int, CLM_FROM_DT string, CLM_THRU_DT string, CLM_DRG_CD string, days double, "
    "codes array<string>, header_dx_count int, line_dx_count int, first_line_dx string, seen_a boolean, seen_b boolean, seen_c boolean"
)


def fact(claim, codes, dx=1):
    return (claim, "p", 1, "20080101", "20080102", None, 1.0, codes, dx, 0, None, True, False, False)


def rule_tables(spark):
    hcpcs = spark.createDataFrame([("99999", True)], "hcpcs_code string, is_noncovered boolean")
    ptp = spark.createDataFrame([("A", "B", "0")], "code1 string, code2 string, modifier string")
    return hcpcs, ptp, spark.createDataFrame([("7", "L")], "article_id string, hcpcs_code string")


def test_segments_of_a_claim_in_different_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[fact("1", ["A"]), fact("2", ["A"])], [fact("1", ["B"]), fact("3", ["L"]), fact(None, ["A", "B"])], [fact("3", [], dx=0)]]
    for rows in batches:
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(path)
    stream = scl.arriving(spark, path, spark.read.parquet(path).schema, max_files=1)
    scl.stream_stage1(stream, *rule_tables(spark), out, str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.CLM_ID or "", r.stage1_reason_code) for r in scl.latest_verdicts(spark, out).collect())
    whole = rl.stage1(spark.createDataFrame(sum(batches, []), FACTS), *rule_tables(spark)).collect()
    assert got == sorted((r.CLM_ID or "", r.stage1_reason_code) for r in whole)
    assert dict(got)["1"] == rl.UNBUNDLING and dict(got)["3"] == rl.CONDITION_UNMET


def test_claims_share_a_state(spark, tmp_path):
    """A state and a frame per claim made many claims slow; claims of a group do not mix."""
    rng = random.Random(4)
    batches = [[fact(str(rng.randrange(150)), rng.sample(["A", "B", "L", "99999", "x", "y"], 2)[: rng.randrange(3)], rng.randrange(2)) for _ in range(120)] for _ in range(3)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(path)
    stream = scl.arriving(spark, path, spark.read.parquet(path).schema, max_files=1)
    query = scl.stream_stage1(stream, *rule_tables(spark), out, str(tmp_path / "ck"), groups=5)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 5
    got = sorted((r.CLM_ID, r.stage1_reason_code) for r in scl.latest_verdicts(spark, out).collect())
    whole = rl.stage1(spark.createDataFrame(sum(batches, []), FACTS), *rule_tables(spark)).collect()
    assert got == sorted((r.CLM_ID, r.stage1_reason_code) for r in whole)
    assert len({reason for _, reason in got}) == 4
    # a conviction is told when a rule first finds it, not again
    told = [tuple(r) for r in spark.read.parquet(out).where("kind = 'conviction'").select("CLM_ID", *scl.FLAGS).collect()]
    assert len(set(told)) == len(told)


def test_a_claim_that_owns_a_third_of_all_rows(spark):
    """Rows of a hot claim are made distinct before any join on the claim id."""
    rows = [fact("hot", [f"c{k % 50}", "L"], dx=0) for k in range(500)] + [fact(str(k), ["A", "B"]) for k in range(1000)]
    facts = spark.createDataFrame(rows, FACTS)
    hcpcs, ptp, links = rule_tables(spark)
    found = rl.undiagnosed_linked_claims(facts, links)
    assert [r.CLM_ID for r in found.collect()] == ["hot"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    right = plan[plan.index("LeftSemi") :]
    assert right.count("Aggregate [CLM_ID") == 2
    verdicts = rl.stage1(facts, hcpcs, ptp, links)
    assert dict(verdicts.groupBy("stage1_reason_code").count().collect()) == {rl.CONDITION_UNMET: 500, rl.UNBUNDLING: 1000}


def test_turn_numbers_with_gaps(spark):
    turns = [(1, 1000 * k, f"p{k}", f"q{k}") for k in range(5)] + [(2, k, f"p{k}", "") for k in range(40)]
    log = spark.createDataFrame(turns, "call_id long, turn long, payer string, provider string")
    got = {(r.call_id, r.turn): r.prior for r in ca.prior_context(log, n=2, block=8).collect()}
    assert got[1, 0] == "" and got[1, 4000] == "PAYER: p2\nPROVIDER: q2\nPAYER: p3\nPROVIDER: q3"
    assert all(got[2, k].startswith(f"PAYER: p{k - 2}\n") for k in range(2, 40))


def test_codes_of_a_claim_over_many_batches(spark, tmp_path):
    """State per claim equals the batch rules whatever batch a code, a pair or a bare row comes in."""
    rng = random.Random(9)
    names = [*"ABCDEFGH", "L", "99999", "x", None]
    batches = [
        [fact(rng.choice(["1", "2", "3", "hot", "hot", None]), rng.choices(names, k=rng.randrange(3)), dx=rng.randrange(3)) for _ in range(20)]
        for _ in range(6)
    ]
    hcpcs = spark.createDataFrame([("99999", True), ("A", False)], "hcpcs_code string, is_noncovered boolean")
    ptp = spark.createDataFrame([("A", "B", "0"), ("D", "C", "0"), ("E", "F", "1"), ("G", "G", "0")], "code1 string, code2 string, modifier string")
    links = spark.createDataFrame([("7", "L")], "article_id string, hcpcs_code string")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(path)
    stream = scl.arriving(spark, path, spark.read.parquet(path).schema, max_files=1)
    query = scl.stream_stage1(stream, hcpcs, ptp, links, out, str(tmp_path / "ck"))
    query.awaitTermination()
    whole = rl.stage1(spark.createDataFrame(sum(batches, []), FACTS), hcpcs, ptp, links)
    got = scl.latest_verdicts(spark, out)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, whole.select(sorted(whole.columns)).collect()))
    # nothing but the batch's own file is read, and a claim sends its state a few codes
    reads = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(reads) == 6 and max(reads) <= 2 * 20
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 4


def test_the_codes_of_a_hot_claim_are_thinned(spark):
    rows = [fact("hot", ["A", "B", "A"], dx=0)] * 3000
    thin = scl._sightings(spark.createDataFrame(rows, FACTS).coalesce(1)).collect()
    assert sorted(map(tuple, thin), key=str) == [("hot", "A", False), ("hot", "B", False), ("hot", None, True)]


def test_pairs_of_a_claim_with_many_codes(spark):
    """Distinct codes of several segments meet block by block; the rows are all pairs."""
    codes = [f"c{k:04d}" for k in range(700)]
    rows = [fact("big", codes[k : k + 40]) for k in range(0, 700, 20)] + [fact("two", ["A"]), fact("two", ["B"]), fact(None, ["A", "B"])]
    facts = spark.createDataFrame(rows, FACTS)
    want = {("big", a, b) for i, a in enumerate(codes) for b in codes[i + 1 :]} | {("two", "A", "B")}
    for block in (8, 64, 10_000):
        got = rl.claim_code_pairs(facts, block).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_demand_of_a_client_with_a_third_of_all_requests(spark):
    rng = random.Random(3)
    rows = [("hot", f"h{k}", rng.choice([1_000_000, rng.randrange(400) * 500_000])) for k in range(600)]
    rows += [(rng.choice(["a", "b", None]), f"r{k}", rng.randrange(200_000_000)) for k in range(300)]
    rows += [("a", "edge", 300_000_000), ("a", "next", 360_000_000), ("a", "past", 360_000_001)]
    log = spark.createDataFrame(rows, "client string, request_id string, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r.request_id: r.demand for r in rq.trailing_demand(log, 60).collect()}
    assert len(got) == len(rows)
    for client, request, at in rows:
        assert got[request] == sum(c == client and at - 60_000_000 <= t <= at for c, _, t in rows)


def test_a_hundred_thousand_turns_behind_one_gap(spark, tmp_path):
    """They wait as one run, and have the phases of the batch once the gap fills; repeats come late."""
    words = ["npi", "claim control number", "status: denied", "press 0", "how can i help", "plain"]
    rng = random.Random(4)
    turns = [(1, t, rng.choice(words)) for t in range(100_001)]
    schema = "call_id long, turn long, payer string"
    stream = files(spark, tmp_path, schema, turns[50_000:], turns[1:50_000] + [(1, 60_000, "bye")], turns[:1] + [(2, 1, "npi"), (1, 7, "zzz")])
    path = str(tmp_path / "events")
    query = (
        sca.call_phase_stream(stream, ca.STATUS_CALL, patience_ms=None).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    events = spark.read.parquet(path)
    assert [tuple(r) for r in events.where("kind = 'run'").select("call_id", "turn", "stop", "phase").collect()] == [(1, 0, 100_000, 1)]
    got = sca.phases_of(events, ca.STATUS_CALL).collect()
    assert sorted(r.turn for r in got if r.late) == [7, 60_000]
    whole = ca.call_phases(spark.createDataFrame(turns, schema), ca.STATUS_CALL)
    assert {(r.call_id, r.turn): r.state for r in got if not r.late} == {(r.call_id, r.turn): r.state for r in whole.collect()}
    assert max(s["memoryUsedBytes"] for p in query.recentProgress for s in p["stateOperators"]) < 2_000_000


def test_composed_maps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 101):
        maps = rng.integers(1, 7, (n, 6)).astype(np.int32)
        want = np.arange(1, 7)
        for m in maps:
            want = m[want - 1]
        assert (sca.composed(maps) == want).all()
