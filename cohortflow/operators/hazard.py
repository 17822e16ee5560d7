"""Penalised cause-specific proportional hazards from distributed risk-set sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import choose_splits, prefix_sums, running_offsets

PENALTY = 0.1


@dataclass
class HazardFit:
    columns: list[str]
    coef: list[float]
    iterations: int
    n: int
    events: int


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _risk_terms(df: DataFrame, cols: list[str], time: str, event: str, beta: np.ndarray, splits: list[float]) -> DataFrame:
    """One row per distinct time: event sums at it and risk sums over all later or equal times."""
    linear = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, cols)), F.lit(0.0))
    risk, dead = F.exp(linear), F.col(event).cast("double")
    sums = {"d": F.sum(dead), "s0": F.sum(risk), "e0": F.sum(dead * risk)}
    for i, c in enumerate(cols):
        sums |= {f"x{i}": F.sum(dead * F.col(c)), f"s1_{i}": F.sum(risk * F.col(c)), f"e1_{i}": F.sum(dead * risk * F.col(c))}
    for i, j in _pairs(len(cols)):
        both = F.col(cols[i]) * F.col(cols[j])
        sums |= {f"s2_{i}_{j}": F.sum(risk * both), f"e2_{i}_{j}": F.sum(dead * risk * both)}
    grouped = df.groupBy(time).agg(*[e.alias(n) for n, e in sums.items()])
    running = [n for n in sums if n.startswith("s")]
    placed = running_offsets(grouped, [], time, running, splits)
    return placed.withColumns({n: F.col(f"{n}_total") - F.col(f"{n}_before") for n in running})


def fit_hazard(
    df: DataFrame, cols: list[str], time: str, event: str, *, penalty: float = PENALTY, max_iter: int = 50, tolerance: float = 1e-9
) -> HazardFit:
    """Newton steps on the partial likelihood with tied events spread over the tie, and the penalty
    n * penalty / 2 * sum(b*b).  Each step is one Spark job that returns a handful of sums."""
    splits = choose_splits(df.select(time).distinct(), time)
    head = df.agg(F.count("*").alias("n"), F.sum(F.col(event)).alias("e")).first()
    d, n = len(cols), int(head["n"])
    beta = np.zeros(d)
    steps = 0
    for steps in range(1, max_iter + 1):
        terms = _risk_terms(df, cols, time, event, beta, splits).filter("d > 0")
        # Event number l of a tie sees the risk sums less the share l/d of the tied events.
        tied = terms.withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)))
        tied = tied.withColumn("_w", F.col("_l") / F.col("d"))
        phi = F.col("s0") - F.col("_w") * F.col("e0")
        mean = [(F.col(f"s1_{i}") - F.col("_w") * F.col(f"e1_{i}")) / phi for i in range(d)]
        grad = [F.sum(F.col(f"x{i}") / F.col("d") - mean[i]).alias(f"g{i}") for i in range(d)]
        hess = [
            F.sum((F.col(f"s2_{i}_{j}") - F.col("_w") * F.col(f"e2_{i}_{j}")) / phi - mean[i] * mean[j]).alias(f"h{i}_{j}")
            for i, j in _pairs(d)
        ]
        row = tied.agg(*grad, *hess).first()
        g = np.array([row[f"g{i}"] for i in range(d)]) - n * penalty * beta
        h = np.zeros((d, d))
        for i, j in _pairs(d):
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        step = np.linalg.solve(h + n * penalty * np.eye(d), g)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return HazardFit(list(cols), [float(b) for b in beta], steps, n, int(head["e"]))


def hazard_table(frame: DataFrame, cause: str, fit: HazardFit, *, penalty: float = PENALTY) -> DataFrame:
    """Coefficients with their direction, one row per input."""
    rows = [
        (cause, c, b, "positive" if b > 0 else "negative" if b < 0 else "zero", penalty, fit.events, fit.n)
        for c, b in zip(fit.columns, fit.coef)
    ]
    return frame.sparkSession.createDataFrame(rows, "cause string, predictor string, coefficient double, direction string, penalty double, events long, n long")


def baseline_cumulative_hazard(df: DataFrame, fit: HazardFit, time: str, event: str) -> DataFrame:
    """Running sum of events over risk sums at every distinct time."""
    splits = choose_splits(df.select(time).distinct(), time)
    terms = _risk_terms(df, fit.columns, time, event, np.array(fit.coef), splits)
    steps = terms.select(time, (F.col("d") / F.col("s0")).alias("_h"))
    summed = prefix_sums(steps, [], time, {"_s": F.sum("_h")}, splits=splits)
    return summed.select(time, (F.col("_s_before") + F.col("_s")).alias("cumulative_hazard"))
