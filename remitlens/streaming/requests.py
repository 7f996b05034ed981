"""Request admission on a stream of (client, request_id, ts)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from remitlens.operators.requests import LIMIT, WINDOW_SECONDS, admit

STATE = "held array<long>, last long"


def output_schema(log: DataFrame) -> str:
    """Columns of the stream; clients and requests keep the type of their ids."""
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("client", "request_id")}
    return f"client {kinds['client']}, request_id {kinds['request_id']}, admitted boolean, late boolean"


def admission_stream(
    log: DataFrame,
    seconds: int = WINDOW_SECONDS,
    limit: int = LIMIT,
    idle_ms: int | None = None,
) -> DataFrame:
    """(client, request_id, admitted, late): requests decided per client as they arrive.

    Rows of one batch are decided in order of time, then request id. A row older than
    the last one decided in an earlier batch comes too late to be decided: it is
    returned with ``late`` and without a verdict. The state is the last time and at
    most ``limit`` admission times; with ``idle_ms`` it is dropped once a client has
    been silent for so long (choose it longer than the window and the usual delay).
    """
    timed = log.select("client", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def decide(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = state.get if state.exists else ([], None)
        held = deque(held)
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        late = rows["at"] < last if last is not None else pd.Series(False, index=rows.index)
        old, new = rows[late], rows[~late]
        if len(new):
            verdicts = admit([int(t) for t in new["at"]], seconds, limit, held)
            state.update((list(held), int(new["at"].iloc[-1])))
            yield new[["client", "request_id"]].assign(admitted=verdicts, late=False)
        if len(old):
            yield old[["client", "request_id"]].assign(admitted=None, late=True)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return timed.groupBy("client").applyInPandasWithState(decide, output_schema(log), STATE, "append", timeout)
