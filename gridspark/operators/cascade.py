"""Cascading failures: violations of one step make failures of the next, so each run is walked step by step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cascade(violations: DataFrame, early_repair: bool = True) -> DataFrame:
    """run_id, step, component_id, type, probability, min_duration of cascading failures and repairs.

    violations: run_id, step, position, component_id, violation, u_fail, u_duration.  In each step open failures are
    looked at from the last one backwards and end when their violation is over; then components fail with
    the probability of their violation.  early_repair keeps the rule that a failure may end while its least
    duration has not passed; otherwise it must have passed.
    """

    def walk(steps: list, components: list, violations: list, u_fail: list, u_duration: list) -> Iterator[tuple]:
        opened, i = [], 0
        while i < len(steps):
            step, j = steps[i], i
            while j < len(steps) and steps[j] == step:
                j += 1
            level = dict(zip(components[i:j], violations[i:j], strict=True))
            for k in range(len(opened) - 1, -1, -1):
                at, component, least = opened[k]
                due = at + least >= step if early_repair else at + least < step
                if due and level.get(component, 0.0) <= 0:
                    yield step, component, "cascading repair", None, -1
                    del opened[k]
            busy = {c for _, c, _ in opened}
            for k in range(i, j):
                p = max(violations[k] * 100, 0.0) ** 1.5 / 100
                if components[k] not in busy and u_fail[k] < p:
                    opened.append((step, components[k], int(p * u_duration[k] * 10)))
                    yield step, components[k], "cascading failure", p, opened[-1][2]
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], []
            for k in range(batch.num_rows):
                before = len(found)
                found += walk(*(batch.column(c)[k].values.to_numpy(zero_copy_only=False).tolist() for c in range(1, 6)))
                size.append(len(found) - before)
            columns = zip(*found, strict=True) if found else [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["run_id", "step", "component_id", "type", "probability", "min_duration"])

    names = ("component_id", "violation", "u_fail", "u_duration")
    order = F.struct("step", F.col("position").isNull(), "position", *names)
    each = violations.where("step is not null").groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.array_sort(F.collect_list(order)).alias("e"))
    return each.select("run_id", "e.step", *(f"e.{c}" for c in names)).mapInArrow(run, "run_id long, step long, component_id long, type string, probability double, min_duration long")
