"""Calibrated probabilities and thresholds, of arrays and of tables of any size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.scratch import written


def _newton(sums: Callable[[float, float], tuple[float, ...]], prior: float) -> tuple[float, float]:
    """sums: of (p - y) x, p - y, w x x, w x and w = p (1 - p) over all rows, for a slope and a shift."""
    a, b = 1.0, 0.0
    for _ in range(50):
        rx, r, wxx, wx, w = sums(a, b)
        g = np.array([rx + prior * (a - 1), r + prior * b])
        h = np.array([[wxx + prior, wx], [wx, w + prior]])
        step = np.linalg.solve(h, g)
        step = step / max(1.0, np.abs(step).max() / 2)  # whole steps may overshoot where classes don't overlap
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def logistic(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[float, float]:
    """Slope and shift of P(y=1) = 1 / (1 + exp(-(slope x + shift))), by Newton's method with a weak pull to 1 and 0."""

    def sums(a: float, b: float) -> tuple[float, ...]:
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, r = p * (1 - p), p - y
        return (r * x).sum(), r.sum(), (w * x * x).sum(), (w * x).sum(), w.sum()

    return _newton(sums, prior)


def logistic_of(rows: DataFrame, prior: float = 1.0) -> tuple[float, float]:
    """The same for all rows of a table with columns x and y: each step is an aggregate."""
    x = F.col("x")

    def sums(a: float, b: float) -> tuple[float, ...]:
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * float(a) + float(b)))))
        each = rows.select("x", p.alias("p"), (p - F.col("y")).alias("r")).withColumn("w", F.col("p") * (1 - F.col("p")))
        return tuple(each.agg(*(F.sum(c) for c in (F.col("r") * x, F.col("r"), F.col("w") * x * x, F.col("w") * x, F.col("w")))).first())

    return _newton(sums, prior)


def best_thresholds(rows: DataFrame, by: str) -> DataFrame:
    """Of each value of `by`, the threshold with the largest F1 over all of its rows, midway between neighbouring scores.

    rows has columns `by`, score and y (0 or 1).  Distinct scores are dealt out by ranges, which hand on their sums, so no
    task holds all rows of a value.  Of equally good thresholds the highest counts.
    """
    each = rows.groupBy(by, "score").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    placed = written(each.repartitionByRange(by, F.desc("score")).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy(by, "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    of_all, before = Window.partitionBy(by), Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(by, "part", F.sum("hits").over(of_all).alias("all_hits"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "hits")))
    so_far = Window.partitionBy(by, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.sum(c).over(so_far) + F.col(f"{c}_before") for c in ("n", "hits")}
    f1 = placed.join(sums, [by, "part"]).select(by, "score", (2 * total["hits"] / (total["n"] + F.col("all_hits"))).alias("f1"))
    best = f1.groupBy(by).agg(F.max(F.struct("f1", "score"))["score"].alias("best"))
    lower = placed.join(best, by).groupBy(by, "best").agg(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("next"))
    return lower.select(by, ((F.col("best") + F.coalesce("next", F.lit(0.0))) / 2).alias("threshold"))
