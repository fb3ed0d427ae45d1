"""When enough runs have been made: indicators, evidence and decisions, and the loop over batches of runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variance_indicator(values: DataFrame, group: list[str], order: str, value: str, backsight: int, tail: bool = False) -> DataFrame:
    """Population variance of the first (or last) ``backsight`` values of each group, over 10."""
    w = Window.partitionBy(*group).orderBy(F.desc(order) if tail else F.asc(order))
    first = values.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= backsight)
    return first.groupBy(*group).agg((F.var_pop(value) / 10).alias("indicator"))


def iteration_indicator(values: DataFrame, group: list[str]) -> DataFrame:
    """Finished runs, counted from -1."""
    return values.groupBy(*group).agg((F.count("*") - 1).cast("double").alias("indicator"))


def threshold_decision(evidence: DataFrame, group: list[str], threshold: float, reverse: bool = False) -> DataFrame:
    """Stop where all evidence is strictly below the threshold, or above it if reversed."""
    test = F.col("indicator") > threshold if reverse else F.col("indicator") < threshold
    return evidence.groupBy(*group).agg(F.bool_and(test).alias("stop"))


def variance(population: Sequence[float], backsight: int, tail: bool = False) -> float:
    part = population[-backsight:] if tail else population[:backsight]
    return float(np.var(part)) / 10 if len(part) else float("nan")


@dataclass
class KalmanEvidence:
    """A scalar Kalman filter whose parameters are learnt from all indicator values so far; the largest smoothed value counts."""

    r: float
    history: list[float] = field(default_factory=lambda: [1.0])
    rounds: int = 10

    @staticmethod
    def _smooth(y: np.ndarray, q: float, r: float, m0: float, p0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(y)
        mean, var, ahead = np.empty(n), np.empty(n), np.empty(n)
        for t in range(n):
            m, p = (m0, p0) if t == 0 else (mean[t - 1], var[t - 1] + q)
            ahead[t] = p
            k = p / (p + r) if p + r else 0.0
            mean[t], var[t] = m + k * (y[t] - m), (1 - k) * p
        link = np.zeros(n)
        for t in range(n - 2, -1, -1):
            g = var[t] / ahead[t + 1] if ahead[t + 1] else 0.0
            mean[t] += g * (mean[t + 1] - mean[t])
            var[t] += g * g * (var[t + 1] - ahead[t + 1])
            link[t + 1] = g * var[t + 1]
        return mean, var, link

    def gather(self, values: Sequence[float]) -> float:
        self.history += list(values)
        y, (q, r, m0, p0) = np.array(self.history, float), (0.0, self.r, 0.0, 1.0)
        for _ in range(self.rounds):
            mean, var, link = self._smooth(y, q, r, m0, p0)
            r = float(np.mean((y - mean) ** 2 + var))
            if len(y) > 1:
                q = float(np.mean((mean[1:] - mean[:-1]) ** 2 + var[1:] + var[:-1] - 2 * link[1:]))
            m0, p0 = float(mean[0]), float(var[0])
        return float(self._smooth(np.array(values, float), max(q, 0.0), r, m0, p0)[0].max())


@dataclass
class StopCriterion:
    """Stops when every evidence of every indicator passes the decision."""

    indicators: Sequence[Callable[[Sequence[float]], list[float]]]
    evidence: Sequence[Callable[[list[float]], float]]
    threshold: float
    reverse: bool = False

    def stop(self, population: Sequence[float]) -> bool:
        found = [e(i(population)) for i, e in zip(self.indicators, self.evidence, strict=True)]
        return all(x > self.threshold if self.reverse else x < self.threshold for x in found)


def mgbm(threshold: float = 0.1, r: float = 1.0, backsight: int = 100) -> StopCriterion:
    return StopCriterion([lambda p: [variance(p, backsight)]], [KalmanEvidence(r).gather], threshold)


def mgbm_after(population: Sequence[float], threshold: float = 0.1, r: float = 1.0, backsight: int = 100, least: int = 2) -> bool:
    """What mgbm() decides after the whole population if it is asked after every run from the ``least``-th on.

    Evidence is learnt from the indicators so far and from nothing else, so it has to be learnt once only, after
    the last run; without ``least`` runs there is no decision to stop.
    """
    if len(population) < least:
        return False
    past = [variance(population[:n], backsight) for n in range(least, len(population))]
    evidence = KalmanEvidence(r, [*KalmanEvidence(r).history, *past])
    return StopCriterion([lambda p: [variance(p, backsight)]], [evidence.gather], threshold).stop(population)


def after(n: int) -> StopCriterion:
    return StopCriterion([lambda p: [float(len(p) - 1)]], [lambda v: v[0]], n, reverse=True)


def run_batches(batch: Callable[[int, int], DataFrame], criterion: StopCriterion, least: int = 2000, size: int = 500, most: int = 1 << 30) -> list[float]:
    """Totals of runs made batch by batch (run_id, total for runs from a to b), until the criterion has enough after ``least`` runs."""
    totals: list[float] = []
    while len(totals) < most:
        rows = batch(len(totals), len(totals) + size).orderBy("run_id").select("total").collect()  # a number for each run
        for (x,) in rows:
            totals.append(x)
            if len(totals) >= least and criterion.stop(totals):
                return totals
        if not rows:
            break
    return totals
