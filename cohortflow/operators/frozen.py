"""Freeze a tuned model as parameter rows, score with it, and bootstrap its odds ratios."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bootstrap import drawn_lists
from .estimators import LogisticFit, balanced_weight, fit_logistic
from .ordered import exact_quantiles
from .preprocess import Preparation, fit_preparation

# Executors receive the helpers of this module by value and need not install the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARAMETER_SCHEMA = "position int, name string, source string, is_indicator boolean, median double, mean double, scale double, coefficient double, intercept double"


def parameter_table(frame: DataFrame, fit: LogisticFit) -> DataFrame:
    """One row per model input with its fill value, scaling and coefficient."""
    rows = []
    for i, name in enumerate(fit.prep.outputs):
        flag = i >= len(fit.prep.columns)
        source = fit.prep.indicators[i - len(fit.prep.columns)] if flag else name
        rows.append(
            (i + 1, name, source, flag, None if flag else fit.prep.medians[name], fit.prep.means[name], fit.prep.scales[name], fit.coef[i], fit.intercept)
        )
    return frame.sparkSession.createDataFrame(rows, PARAMETER_SCHEMA)


def load_parameters(table: DataFrame) -> LogisticFit:
    """Model from its parameter rows (as many rows as the model has inputs)."""
    rows = sorted(table.collect(), key=lambda r: r["position"])
    plain = [r for r in rows if not r["is_indicator"]]
    prep = Preparation(
        [r["name"] for r in plain], {r["name"]: r["median"] for r in plain}, [r["source"] for r in rows if r["is_indicator"]],
        {r["name"]: r["mean"] for r in rows}, {r["name"]: r["scale"] for r in rows},
    )
    return LogisticFit(prep, [r["coefficient"] for r in rows], rows[0]["intercept"], 0, True, {})


def score_frozen(df: DataFrame, table: DataFrame, ids: list[str]) -> DataFrame:
    """Ids and probabilities; the input must hold exactly the ids and the model's columns.  Also serves streams."""
    fit = load_parameters(table)
    expected = {*ids, *fit.prep.columns}
    if set(df.columns) != expected:
        raise ValueError(f"columns must be exactly {sorted(expected)}")
    return df.select(*ids, fit.score().alias("probability"))


def formula_gap(df: DataFrame, fit: LogisticFit, table: DataFrame, ids: list[str]) -> DataFrame:
    """Largest difference between the fitted model and its reloaded parameters, one row."""
    a = df.select(*ids, fit.score().alias("a"))
    b = score_frozen(df, table, ids)
    return a.join(b, ids).agg(F.max(F.abs(F.col("a") - F.col("probability"))).alias("max_error"), F.count("*").alias("n"))


def weighted_refits(
    rows: DataFrame, inputs: int, *, C: float, l1_ratio: float, balanced: bool, max_iter: int = 60, tol: float = 1e-10
) -> dict[int, np.ndarray]:
    """Coefficients (intercept first) of one penalised logistic refit per replicate, all of them side by side.

    `rows` has `x` (scaled inputs), `y` and `reps` (one entry per draw of the row).  A Newton step of all replicates is one
    pass over the rows: every task sums gradients and curvatures of its rows per replicate, Spark adds them up, and only
    those sums, a number that does not grow with the rows, reach the driver.  Replicates with one class are left out.
    """
    p = inputs + 1
    sizes = {r["rep"]: (r["n"], r["positive"]) for r in rows.select("y", F.explode("reps").alias("rep")).groupBy("rep").agg(
        F.count("*").alias("n"), F.sum("y").alias("positive")).collect()}
    live = sorted(r for r, (total, pos) in sizes.items() if 0 < pos < total)
    if not live:
        return {}
    place = {r: i for i, r in enumerate(live)}
    total = np.array([sizes[r][0] for r in live], float)
    pos = np.array([sizes[r][1] for r in live], float)
    share = np.stack([total / (2 * (total - pos)), total / (2 * pos)], axis=1) if balanced else np.ones((len(live), 2))
    beta = np.zeros((len(live), p))
    reg = 1.0 / C  # the penalty is 1 / (C * weight) per unit of mean loss, 1 / C on sums

    def sums(current: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches):
            gradient, curve = np.zeros((len(live), p)), np.zeros((len(live), p, p))
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    piece = batch.slice(start, 1000)
                    x = np.array(piece.column("x").to_pylist(), float).reshape(piece.num_rows, inputs)
                    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                    y = np.array(piece.column("y").to_pylist(), float)
                    weight = np.zeros((len(x), len(live)))
                    for i, reps in enumerate(piece.column("reps").to_pylist()):
                        at = [place[r] for r in reps if r in place]
                        np.add.at(weight[i], at, 1.0)
                    weight *= np.where(y[:, None] == 1, share[:, 1], share[:, 0])
                    score = 1 / (1 + np.exp(-np.clip(x @ current.T, -35, 35)))
                    gradient += np.einsum("mb,mp->bp", weight * (score - y[:, None]), x)
                    bend = weight * score * (1 - score)
                    curve += np.stack([(bend * x[:, [j]]).T @ x for j in range(p)], axis=1)
            values = np.concatenate([gradient, curve.reshape(len(live), p * p)], axis=1)
            b, k = np.indices(values.shape)
            yield pa.RecordBatch.from_arrays([pa.array(b.ravel()), pa.array(k.ravel()), pa.array(values.ravel())], ["b", "k", "v"])

        out = np.zeros((len(live), p + p * p))
        for r in rows.select("x", "y", "reps").mapInArrow(part, "b long, k long, v double").groupBy("b", "k").agg(F.sum("v").alias("v")).collect():
            out[r["b"], r["k"]] = r["v"]
        return out[:, :p], out[:, p:].reshape(len(live), p, p)

    l2, l1 = reg * (1 - l1_ratio), reg * l1_ratio
    free = np.array([0.0] + [1.0] * inputs)
    for _ in range(max_iter):
        gradient, curve = sums(beta)
        curve = curve + np.diag(l2 * free + 1e-12)
        gradient = gradient + l2 * free * beta
        new = beta.copy()
        if l1 == 0:
            new -= np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        else:  # coordinate descent on the quadratic model
            slope = gradient.copy()
            for _ in range(500):
                before = new.copy()
                for j in range(p):
                    h = curve[:, j, j]
                    raw = new[:, j] - slope[:, j] / h
                    value = raw if j == 0 else np.sign(raw) * np.maximum(np.abs(raw) - l1 / h, 0.0)
                    slope += curve[:, :, j] * (value - new[:, j])[:, None]
                    new[:, j] = value
                if np.abs(new - before).max() < tol / 10:
                    break
        moved = np.abs(new - beta).max()
        beta = new
        if moved < tol:
            break
    return {r: beta[place[r]] for r in live}


def odds_ratio_bootstrap(
    train: DataFrame, columns: list[str], *, replicates: int = 200, seed: int = 42, C: float = 1.0, l1_ratio: float = 0.0, balanced: bool = True
) -> DataFrame:
    """Coefficient and odds ratio per input with percentile intervals over weighted refits.

    A refit that fails (one class drawn) is left out.  All refits advance together, one pass over the rows per step.
    """
    prep = fit_preparation(train, columns)
    weight = balanced_weight(train) if balanced else F.lit(1.0)
    point = fit_logistic(train, columns, C=C, l1_ratio=l1_ratio, prep=prep, weight=weight)
    ready = train.select("entity_id", F.array(*prep.scaled().values()).alias("x"), F.col("label").cast("long").alias("y"))
    drawn = drawn_lists(ready, train, replicates, seed).persist()
    fits = weighted_refits(drawn, len(prep.outputs), C=C, l1_ratio=l1_ratio, balanced=balanced)
    drawn.unpersist()
    spark = train.sparkSession
    rows = [(n, float(c)) for b in sorted(fits) for n, c in zip(prep.outputs, fits[b][1:])]
    boot = spark.createDataFrame(rows, "feature string, coef double")
    bounds = exact_quantiles(boot, ["feature"], ["coef"], {"ci_low": 0.025, "ci_high": 0.975}, hot_rows=None)
    table = spark.createDataFrame(list(zip(prep.outputs, point.coef)), "feature string, coef double")
    return table.join(bounds, "feature").select(
        "feature", "coef", F.exp("coef").alias("odds_ratio"), "coef_ci_low", "coef_ci_high",
        F.exp("coef_ci_low").alias("or_ci_low"), F.exp("coef_ci_high").alias("or_ci_high"), F.abs("coef").alias("abs_coef"),
    ).orderBy(F.desc("abs_coef"), "feature")
