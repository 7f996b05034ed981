"""Call phases across micro-batches, with turns that may arrive out of order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from remitlens.operators.calls import CallFlow, prefix_phases, turn_maps

#: The phase before ``next_turn``, and the runs of neighbouring turns that wait behind a gap, each
#: with the one map that all its turns make together.
STATE = "phase int, next_turn long, starts array<long>, stops array<long>, maps array<int>"
EVENT = ["call_id", "kind", "turn", "stop", "phase", "map"]


def event_schema(turns: DataFrame) -> str:
    """Columns of the stream; call ids keep their own type."""
    return f"call_id {turns.schema['call_id'].dataType.simpleString()}, kind string, turn long, stop long, phase int, map array<int>"


def composed(maps: np.ndarray) -> np.ndarray:
    """The map of all ``maps`` (a row each, phases from 1) one after the other, joined pair by pair."""
    while len(maps) > 1:
        even = len(maps) - len(maps) % 2
        pairs = np.take_along_axis(maps[1:even:2], maps[0:even:2] - 1, axis=1)
        maps = np.concatenate([pairs, maps[even:]])
    return maps[0]


def joined_runs(runs: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, np.ndarray]]:
    """Runs (start, stop, map) in order, those that follow on each other made one."""
    out: list[tuple[int, int, np.ndarray]] = []
    for start, stop, map_ in sorted(runs, key=lambda r: r[0]):
        if out and out[-1][1] + 1 == start:
            first = out.pop()
            start, map_ = first[0], map_[first[2] - 1]
        out.append((start, stop, map_))
    return out


def call_phase_stream(
    turns: DataFrame,
    flow: CallFlow,
    first_turn: int = 0,
    patience_ms: int | None = 60_000,
    most_runs: int | None = None,
) -> DataFrame:
    """Events of the calls, to be stored: turns as they arrive, runs as they become decidable.

    Patterns are tested natively; only the replay is Python. An event of kind ``turn``
    holds a turn and its map of phases, ``run`` a run of neighbouring turns (``turn`` to
    ``stop``) and the phase before it, ``late`` a turn that came when its place was
    decided or taken, and can no longer change a phase. ``phases_of`` gives the phase of
    every decided turn from the stored events.

    A turn that is ahead of its turn waits until the gap fills, until ``patience_ms``
    pass without news of the call, or, if ``most_runs`` is given, until more runs than
    that wait (which bounds the state, at the price of gaps that would have filled);
    then the waiting turns are taken as they are. The state holds a run, however long,
    as its ends and one map, never its turns. Without ``patience_ms`` no time is watched; a
    bounded run (``availableNow``) needs that, because Spark keeps a query with
    processing-time timeouts alive to serve them.
    """
    maps = turn_maps(turns, flow).select(
        "call_id", F.col("turn").cast("long").alias("turn"), "map"
    )
    width = len(flow.phases)

    def events(key: tuple, kind: str, turn, **more) -> pd.DataFrame:
        return pd.DataFrame({"call_id": key[0], "kind": kind, "turn": turn, "stop": None, "phase": None, "map": None} | more)[EVENT]

    def replay(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        phase, expected, starts, stops, flat = state.get if state.exists else (1, first_turn, [], [], [])
        waiting = np.array(flat, np.int32).reshape(-1, width)
        runs = [(a, b, waiting[i]) for i, (a, b) in enumerate(zip(starts, stops))]
        arrived = [(b["turn"].to_numpy(np.int64), np.array(b["map"].tolist(), np.int32).reshape(-1, width)) for b in batches if len(b)]
        if arrived:
            turn, after = (np.concatenate(x) for x in zip(*arrived))
            # equal turns of a batch in the order of their maps, so that a replay takes the same one
            order = np.lexsort((*after.T[::-1], turn))
            turn, after = turn[order], after[order]
            late = (turn < expected) | np.append(False, turn[1:] == turn[:-1])
            if runs:
                at = np.searchsorted(starts, turn, side="right") - 1
                late |= (at >= 0) & (turn <= np.array(stops)[np.maximum(at, 0)])
            if late.any():
                yield events(key, "late", turn[late])
            turn, after = turn[~late], after[~late]
            if len(turn):
                yield events(key, "turn", turn, map=list(after))
                cuts = np.flatnonzero(np.diff(turn) != 1) + 1
                for a, b in zip([0, *cuts], [*cuts, len(turn)]):
                    runs.append((int(turn[a]), int(turn[b - 1]), composed(after[a:b])))
        runs, decided = joined_runs(runs), []
        while runs:
            forced = state.hasTimedOut or (most_runs is not None and len(runs) > most_runs)
            if runs[0][0] != expected and not forced and not (decided and decided[-1][3]):
                break
            start, stop, map_ = runs.pop(0)
            # once a gap is passed over, all that waits is taken
            decided.append((start, stop, phase, start != expected or bool(decided and decided[-1][3])))
            phase, expected = int(map_[phase - 1]), stop + 1
        state.update(
            (phase, expected, [r[0] for r in runs], [r[1] for r in runs], np.concatenate([r[2] for r in runs]).tolist() if runs else [])
        )
        if runs and patience_ms is not None:
            state.setTimeoutDuration(patience_ms)
        if decided:
            start, stop, before, _ = zip(*decided)
            yield events(key, "run", list(start), stop=list(stop), phase=list(before))

    timeout = (
        GroupStateTimeout.NoTimeout
        if patience_ms is None
        else GroupStateTimeout.ProcessingTimeTimeout
    )
    return maps.groupBy("call_id").applyInPandasWithState(
        replay, event_schema(turns), STATE, "append", timeout
    )


def phases_of(events: DataFrame, flow: CallFlow) -> DataFrame:
    """(call_id, turn, state, late) from the stored events of ``call_phase_stream``.

    Turns up to the last decided run have their phase; turns that still wait have no
    row yet; late ones have a row without a phase, so nothing is lost unseen.
    """
    last = events.where("kind = 'run'").groupBy("call_id").agg(F.max("stop").alias("last"))
    turns = events.where("kind = 'turn'").select(F.col("call_id").alias("of"), F.col("turn").alias("pos"), "map")
    decided = turns.join(last, turns["of"].eqNullSafe(last["call_id"])).where("pos <= last")
    names = F.array(*[F.lit(p) for p in flow.phases])
    phases = prefix_phases(decided.select("call_id", "pos", "map"), len(flow.phases)).select(
        "call_id", F.col("pos").alias("turn"), F.element_at(names, F.col("after")).alias("state"), F.lit(False).alias("late")
    )
    late = events.where("kind = 'late'").select(
        "call_id", "turn", F.lit(None).cast("string").alias("state"), F.lit(True).alias("late")
    )
    return phases.unionByName(late)
