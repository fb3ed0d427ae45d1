"""A scalar Kalman filter and smoother over series of any length, as a scan of elements that can be joined in any grouping.

The state stays as it is but for noise of variance q, and is seen with noise of variance r > 0.  A stretch of steps is
one element: what it makes of the state before it, and how likely that state was.  Elements of neighbouring stretches
join to one, so blocks of steps are reduced side by side, then the blocks of a series one after the other (a row
each), and then every block is walked from the state that it begins with.  Smoothing does the same backwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.sources.shared import dropped, stored

Element = tuple[float, ...]


def step(y: float, q: float, r: float) -> Element:
    """gain, shift, spread: the state afterwards is gain * before + shift, of variance spread; score, weight: what y says of the state before."""
    s = q + r
    return r / s, q / s * y, q * r / s, y / s, 1 / s


def start(y: float, m0: float, p0: float, r: float) -> Element:
    """The first step, which knows the state before it."""
    k = p0 / (p0 + r)
    return 0.0, m0 + k * (y - m0), (1 - k) * p0, 0.0, 0.0


def joined(a: Element, b: Element) -> Element:
    """The element of two stretches, a before b."""
    gain_a, shift_a, spread_a, score_a, weight_a = a
    gain_b, shift_b, spread_b, score_b, weight_b = b
    d = 1 / (1 + spread_a * weight_b)
    return gain_b * d * gain_a, gain_b * d * (shift_a + spread_a * score_b) + shift_b, gain_b * d * spread_a * gain_b + spread_b, gain_a * d * (score_b - weight_b * shift_a) + score_a, gain_a * d * weight_b * gain_a + weight_a


def back(m: float, p: float, q: float, last: bool) -> Element:
    """The smoothed state is pull * the next smoothed one + shift; its variance pull * the next one's * pull + spread."""
    pull = 0.0 if last or not p + q else p / (p + q)
    return pull, m - pull * m, p - pull * p


def joined_back(a: Element, b: Element) -> Element:
    """The element of two stretches, a before b, that leads from what follows b to the beginning of a."""
    return a[0] * b[0], a[0] * b[1] + a[1], a[0] * b[2] * a[0] + a[2]


def smoothed(series: DataFrame, params: DataFrame, keys: list[str], block: int = 1024) -> DataFrame:
    """keys, t, y, mean, var, change of series (keys, t from 0 without gaps, y).

    params: keys, q, r, m0, p0 (mean and variance before the first step).  mean and var are the smoothed state's; change
    is the expected square of its move to the next step, null at the last.  Series without parameters are left out.
    """
    types = {f.name: f.dataType.simpleString() for f in series.schema}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    n = series.groupBy(*keys).agg((F.count("*") - 1).alias("_end"))
    rows = series.select(*keys, F.col("t").cast("long").alias("t"), F.col("y").cast("double").alias("y")).join(params.select(*keys, "q", "r", "m0", "p0"), keys).join(n, keys).withColumn("_block", F.floor(F.col("t") / block))

    def grouped(frame: DataFrame, by: list[str], columns: list[str], run: Callable[..., Iterable[tuple]], schema: str, turned: bool = False) -> DataFrame:
        """run(lists of the columns) for each group, in the order of the first column; many groups go through one batch."""
        each = frame.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns)), not turned).alias("_e")).select(*by, *(F.col(f"_e.{c}").alias(f"_{c}") for c in columns))
        fields = [part.split() for part in schema.split(", ")]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [batch.column(len(by) + k).to_pylist() for k in range(len(columns))]
                found, size = [], []
                for parts in zip(*lists, strict=True):
                    before = len(found)
                    found += run(*parts)
                    size.append(len(found) - before)
                at = pa.array(np.repeat(np.arange(len(size)), size))
                out = zip(*found, strict=True) if found else [()] * len(fields)
                made = [pa.array(x, {"long": pa.int64(), "double": pa.float64()}[kind]) for x, (_, kind) in zip(out, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(by))), *made], names=[*by, *(name for name, _ in fields)])

        ids = named + (", _block long" if "_block" in by else "")
        return each.mapInArrow(go, f"{ids}, {schema}")

    def total(*parts: list) -> Iterable[tuple]:
        out = None
        for t, y, q, r, m0, p0 in zip(*parts, strict=True):
            one = step(y, q, r) if t else start(y, m0, p0, r)
            out = joined(out, one) if out else one
        return [out]

    def entered(blocks: list, *parts: list) -> Iterable[tuple]:
        out = None
        for at, *one in zip(blocks, *parts, strict=True):
            yield at, *(out[1:3] if out else (None, None))
            out = joined(out, one) if out else one

    def forward(*parts: list) -> Iterable[tuple]:
        m = None
        for t, y, q, r, m0, p0, end, m1, p1 in zip(*parts, strict=True):
            if m is None:
                m, p = m1, p1
            m, p = (m, p + q) if t else (m0, p0)
            k = p / (p + r)
            m, p = m + k * (y - m), (1 - k) * p
            yield t, y, q, end, m, p

    def total_back(*parts: list) -> Iterable[tuple]:
        out = None
        for t, m, p, q, end in zip(*parts, strict=True):
            one = back(m, p, q, t == end)
            out = joined_back(one, out) if out else one
        return [out]

    def entered_back(blocks: list, *parts: list) -> Iterable[tuple]:
        out = None
        for at, *one in zip(blocks, *parts, strict=True):
            yield at, *(out[1:3] if out else (None, None))
            out = joined_back(one, out) if out else one

    def backward(*parts: list) -> Iterable[tuple]:
        begun = False
        for t, y, m, p, q, end, sm, sp in zip(*parts, strict=True):
            if not begun:
                m1, p1, begun = sm, sp, True
            pull, shift, spread = back(m, p, q, t == end)
            mean, var = (shift, spread) if t == end else (pull * m1 + shift, pull * pull * p1 + spread)
            yield t, y, mean, var, None if t == end else (m1 - mean) ** 2 + p1 + var - 2 * pull * p1
            m1, p1 = mean, var

    at, seen = [*keys, "_block"], ["t", "y", "q", "r", "m0", "p0"]
    element = [f"e{k}" for k in range(5)]
    begin = grouped(grouped(rows, at, seen, total, ", ".join(f"{e} double" for e in element)), keys, ["_block", *element], entered, "_block long, m double, p double")
    passed = stored(grouped(rows.join(begin, at), at, [*seen, "_end", "m", "p"], forward, "t long, y double, q double, _end long, m double, p double"), "filtered")
    after = grouped(grouped(passed, at, ["t", "m", "p", "q", "_end"], total_back, ", ".join(f"{e} double" for e in element[:3]), True), keys, ["_block", *element[:3]], entered_back, "_block long, sm double, sp double", True)
    out = grouped(passed.join(after, at), at, ["t", "y", "m", "p", "q", "_end", "sm", "sp"], backward, "t long, y double, mean double, var double, change double", True).drop("_block")
    return out.withColumn("change", F.when(~F.isnan("change"), F.col("change")))


def learnt(series: DataFrame, keys: list[str], r: float, rounds: int = 10, block: int = 1024) -> DataFrame:
    """keys, q, r, m0, p0 after so many rounds of expectation and maximisation, beginning with 0, r, 0 and 1; written after each."""
    params = series.select(*keys).distinct().select(*keys, F.lit(0.0).alias("q"), F.lit(r).alias("r"), F.lit(0.0).alias("m0"), F.lit(1.0).alias("p0"))
    for turn in range(rounds):
        s = smoothed(series, params, keys, block)
        first = lambda c: F.max(F.when(F.col("t") == 0, F.col(c)))
        seen = F.avg((F.col("y") - F.col("mean")) * (F.col("y") - F.col("mean")) + F.col("var"))
        new = s.groupBy(*keys).agg(F.avg("change").alias("_q"), seen.alias("r"), first("mean").alias("m0"), first("var").alias("p0"))
        old, params = params, stored(new.join(params.select(*keys, "q"), keys).select(*keys, F.coalesce("_q", "q").alias("q"), "r", "m0", "p0"), "params")
        if turn:
            dropped(old)
    return params
