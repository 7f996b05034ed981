"""Request log: demand in the trailing window and exact admission.

Both split a client's log by time, so one busy client is many groups.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS, LIMIT = 60, 60
#: Sub-cells of a window in which requests are counted.
SUB_CELLS = 16


def _cells(log: DataFrame, seconds: int) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return log.select(
        "client", "request_id", micros.alias("at"),
        F.floor(micros / (seconds * 1_000_000)).alias("cell"),
    )


def trailing_demand(log: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Requests of the client in the ``seconds`` up to and including each request.

    Requests are counted per client and microsecond first, so many at one moment are
    one row. The count up to a moment is the count of the sub-cells before its own and
    of the moments up to it in its own; the demand is that count less the one just
    before the window. So no group is larger than the microseconds of a sub-cell, and a
    busy client is as many groups as its log has sub-cells.
    """
    width = max(1, seconds * 1_000_000 // SUB_CELLS)
    requests = _cells(log, seconds).select("client", "request_id", "at")
    moments = requests.groupBy("client", "at").agg(F.count("*").alias("n"))
    edges = moments.select("client", (F.col("at") - seconds * 1_000_000).alias("at"), F.lit(0).cast("bigint").alias("n"))
    marked = moments.withColumn("edge", F.lit(False)).unionByName(edges.withColumn("edge", F.lit(True)))
    marked = marked.withColumn("sub", F.floor(F.col("at") / width))
    before = Window.partitionBy("client").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = marked.groupBy("client", "sub").agg(F.sum("n").alias("n"))
    subs = subs.select(
        F.col("client").alias("of"), F.col("sub").alias("of_sub"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    inside = Window.partitionBy("client", "sub").orderBy("at")
    counted = marked.select(
        "client", "sub", "at", "edge",
        F.sum("n").over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("up_to"),
        F.coalesce(F.sum("n").over(inside.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
    )
    same = F.col("client").eqNullSafe(F.col("of")) & (F.col("sub") == F.col("of_sub"))
    counted = counted.join(subs, same)
    part = F.when(F.col("edge"), -(F.col("below") + F.col("earlier"))).otherwise(F.col("up_to") + F.col("earlier"))
    moment = F.when(F.col("edge"), F.col("at") + seconds * 1_000_000).otherwise(F.col("at"))
    demand = counted.groupBy(F.col("client").alias("of"), moment.alias("moment")).agg(F.sum(part).alias("demand"))
    here = F.col("client").eqNullSafe(F.col("of")) & (F.col("at") == F.col("moment"))
    return requests.join(demand, here).select("client", "request_id", "demand")


def busy_runs(cells: DataFrame) -> DataFrame:
    """(client, cell, run): runs of neighbouring cells with requests. An empty
    cell between two requests is at least a whole window, so nothing admitted
    before it counts after it and runs can be decided apart. Cells are counted
    once per client and cell: their number is the log's length in windows."""
    used = cells.select("client", "cell").distinct()
    by_cell = Window.partitionBy("client").orderBy("cell")
    starts = (F.col("cell") - F.lag("cell").over(by_cell)) != 1
    return used.withColumn("new", F.coalesce(starts, F.lit(True)).cast("int")).select(
        "client", "cell", F.sum("new").over(by_cell).alias("run")
    )


def admit(times: list[int], seconds: int, limit: int, held: deque | None = None) -> list[bool]:
    """Decide requests in time order; only admitted ones occupy the window.
    ``held`` are the admission times still in the window."""
    held = deque() if held is None else held
    verdicts = []
    for at in times:
        while held and held[0] < at - seconds * 1_000_000:
            held.popleft()
        verdicts.append(len(held) < limit)
        if verdicts[-1]:
            held.append(at)
    return verdicts


def admission(log: DataFrame, seconds: int = WINDOW_SECONDS, limit: int = LIMIT) -> DataFrame:
    """(client, request_id, admitted), in order of time, then request id.

    Rows are sorted by run inside each partition and streamed through in Arrow
    batches: the state is the admission times of one window, so even a client
    that is never idle is decided in bounded memory.
    """
    cells = _cells(log, seconds)
    runs = cells.join(busy_runs(cells), ["client", "cell"]).select(
        "client", "run", "at", "request_id"
    )
    ordered = runs.repartition("client", "run").sortWithinPartitions(
        "client", "run", "at", "request_id"
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for batch in batches:
            verdicts: list[bool] = []
            for key, part in batch.groupby(["client", "run"], sort=False, dropna=False):
                if key != current:
                    current, held = key, deque()
                verdicts.extend(admit(part["at"].tolist(), seconds, limit, held))
            yield batch[["client", "request_id"]].assign(admitted=verdicts)

    schema = ", ".join(
        [
            f"client {log.schema['client'].dataType.simpleString()}",
            f"request_id {log.schema['request_id'].dataType.simpleString()}",
            "admitted boolean",
        ]
    )
    return ordered.mapInPandas(decide, schema)
