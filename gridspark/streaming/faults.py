"""Runs as streams: fault states that follow events as they arrive, and observations appended by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def component_states(events: DataFrame, idle: int = 24 * 3_600_000) -> DataFrame:
    """run_id, node, step, active after each event of a stream (run_id, node, step, kind: 0 failure, 1 repair).

    The state of a component is its last event by step and kind; earlier ones that arrive late are passed over.  A
    component of which nothing has come for ``idle`` milliseconds is forgotten, so runs that are over take no memory;
    should it come back, it starts anew.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = tuple(state.get) if state.exists else (-1, -1)
        for frame in frames:
            frame = frame.sort_values(["step", "kind"])
            kept = frame[(frame["step"] > last[0]) | (frame["step"] == last[0]) & (frame["kind"] >= last[1])]
            if len(kept):
                last = int(kept["step"].iloc[-1]), int(kept["kind"].iloc[-1])
                yield pd.DataFrame({"run_id": key[0], "node": key[1], "step": kept["step"], "active": kept["kind"] == 1})
        state.update(last)
        state.setTimeoutDuration(idle)

    return events.groupBy("run_id", "node").applyInPandasWithState(follow, "run_id long, node string, step long, active boolean", "step long, kind long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_loss(perf: DataFrame, time: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Loss per carrier and window of event time; rows later than the watermark are passed over."""
    return perf.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "experiment").agg(*(F.sum(c).alias(c) for c in ("p0", "p1", "p2")))


def append_observations(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream of observations to a table, each micro-batch once; ends when what there is has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("experiment").trigger(availableNow=True).start()
