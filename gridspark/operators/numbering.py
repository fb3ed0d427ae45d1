"""Numbers in a global order, without bringing all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.sources.shared import stored


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place (from 0) of each row in the given order, nulls first.

    Rows go to ranges, which are sorted and numbered side by side; what a range adds is the number of rows in those
    before it.  The ranges are written, as their bounds must be the same when they are counted and when they are
    numbered.  Rows of equal keys share a range, so keys should be few or distinct.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranges.withColumns({"_part": part, "_at": at - F.shiftleft(part.cast("long"), 33)}), "numbered")
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # a row for each range
    if not counts:
        return placed.select(*df.columns, F.col("_at").alias(name))
    before = accumulate([n for _, n in counts[:-1]], initial=0)
    offsets = F.create_map(*(F.lit(x) for (p, _), b in zip(counts, before, strict=True) for x in (p, b)))
    return placed.select(*df.columns, (F.col("_at") + F.element_at(offsets, F.col("_part"))).cast("long").alias(name))
