"""Single fits with the study's own preparation and penalty scale: logistic models on Spark ML, trees of `trees`."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BALANCED_C_GRID, ELASTIC_C_GRID, ELASTIC_L1_GRID, L2_GRID, TREE_GRID
from . import trees
from .preprocess import Preparation, fit_preparation

MAX_ITER = 5000
#: Relative change at which a fit stops; small enough that scores do not depend on the order of summation.
TOLERANCE = 1e-13


@dataclass
class LogisticFit:
    prep: Preparation
    coef: list[float]
    intercept: float
    iterations: int
    converged: bool
    params: dict

    def score(self) -> Column:
        """Probability as a column expression over the raw inputs."""
        linear = F.lit(self.intercept)
        for weight, expr in zip(self.coef, self.prep.scaled().values()):
            if weight:
                linear = linear + F.lit(weight) * expr
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))


@dataclass
class PriorFit:
    prevalence: float
    params: dict

    def score(self) -> Column:
        return F.lit(self.prevalence)


@dataclass
class ForestFit:
    """Trees as a table of nodes, see `trees.grow_forests`."""

    prep: Preparation
    nodes: DataFrame
    params: dict

    def scored(self, df: DataFrame, out: str = "score") -> DataFrame:
        rows = df.select(F.struct("*").alias("_row"), F.array(*self.prep.filled().values()).alias("x"), F.array(F.lit(0)).alias("forests"))
        return trees.score_forests(rows, self.nodes, keep=["_row"]).select("_row.*", F.col("score").alias(out))


def _as_vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_features", array_to_vector("_x"))


ROWS_PER_TASK = 200_000


def class_weight(n: int, positives: int, label: str = "label") -> Column:
    """n / (2 * class size) of each row's class."""
    return F.when(F.col(label) == 1, F.lit(n / (2.0 * positives))).otherwise(F.lit(n / (2.0 * (n - positives))))


def balanced_weight(train: DataFrame, label: str = "label") -> Column:
    r = train.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    return class_weight(r["n"], r["p"], label)


def training_rows(train: DataFrame, prep: Preparation, label: str = "label", weight: Column | None = None) -> DataFrame:
    """Scaled inputs as one vector column with label and weight, in as many tasks as the rows need."""
    cols = [F.array(*prep.scaled().values()).alias("_x"), F.col(label).cast("double").alias("label")]
    rows = train.select(*cols, (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"))
    packed = _as_vector(rows).drop("_x")
    return packed.coalesce(max(1, -(-prep.rows // ROWS_PER_TASK))) if prep.rows else packed


def fit_logistic(
    train: DataFrame, columns: list[str], *, C: float = 1.0, l1_ratio: float = 0.0, label: str = "label", indicators: bool = False,
    weight: Column | None = None, prep: Preparation | None = None, rows: DataFrame | None = None, total: float | None = None,
    max_iter: int = MAX_ITER,
) -> LogisticFit:
    """Penalised logistic fit; the penalty is 1/(C * sum of weights) per unit of mean loss, the intercept is free."""
    prep = prep or fit_preparation(train, columns, indicators=indicators)
    data = rows if rows is not None else training_rows(train, prep, label, weight)
    weights = total if total is not None else data.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="weight", regParam=1.0 / (C * weights), elasticNetParam=l1_ratio,
        standardization=False, maxIter=max_iter, tol=TOLERANCE,
    ).fit(data)
    used = int(model.summary.totalIterations)
    return LogisticFit(
        prep, [float(v) for v in model.coefficients], float(model.intercept), used, used < max_iter, {"C": C, "l1_ratio": l1_ratio}
    )


def fit_prior(train: DataFrame, label: str = "label") -> PriorFit:
    return PriorFit(float(train.agg(F.avg(F.col(label).cast("double"))).first()[0]), {})


def fit_forest(train: DataFrame, columns: list[str], params: dict, *, seed: int = 42, label: str = "label", local_rows: int = trees.LOCAL_ROWS) -> ForestFit:
    """Extremely randomised trees: no row resampling, random inputs and thresholds per node, unlimited depth by default."""
    prep = fit_preparation(train, columns, scale=False, label=label)
    rows = train.select(F.lit(0).alias("members"), F.array(*prep.filled().values()).alias("x"), F.col(label).cast("int").alias("y"))
    spec = trees.forest_spec(0, 0, params, len(columns), prep.rows, prep.positives)
    return ForestFit(prep, trees.grow_forests(rows, [spec], seed=seed, local_rows=local_rows), dict(params))


def l2_grid() -> list[dict]:
    return [{"C": c, "l1_ratio": 0.0} for c in L2_GRID]


def elastic_grid(cs: list[float] = ELASTIC_C_GRID, ratios: list[float] = ELASTIC_L1_GRID) -> list[dict]:
    return [{"C": c, "l1_ratio": r} for c in cs for r in ratios]


def balanced_grid() -> list[dict]:
    return [{"C": c, "l1_ratio": r} for r in (1.0, 0.0) for c in BALANCED_C_GRID]


def tree_draws(n_iter: int, seed: int, grid: dict = TREE_GRID) -> list[dict]:
    """Seeded random settings from the tree grid, none twice."""
    size = math.prod(len(v) for v in grid.values())
    out = []
    for number in random.Random(seed).sample(range(size), min(n_iter, size)):
        setting = {}
        for k, values in grid.items():
            number, at = divmod(number, len(values))
            setting[k] = values[at]
        out.append(setting)
    return out
