"""Fitted input preparation: median fill, missing indicators, population scaling, category coding."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import nan_to_null
from .ordered import HOT_ROWS, exact_quantiles, rows_allowed


@dataclass
class Preparation:
    """Values learned from training rows, one entry per input or indicator column."""

    columns: list[str]
    medians: dict[str, float]
    indicators: list[str] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    rows: int = 0
    positives: int = 0

    def set_scale(self, name: str, mean: float, spread: float) -> None:
        self.means[name] = mean
        self.scales[name] = spread if spread > 1e-12 * max(1.0, abs(mean)) else 1.0

    def subset(self, columns: list[str]) -> "Preparation":
        """The same values for some of the inputs."""
        return Preparation(
            list(columns), self.medians, [c for c in columns if c in self.indicators], self.means, self.scales, self.rows, self.positives
        )

    @property
    def outputs(self) -> list[str]:
        return [*self.columns, *[f"missing_{c}" for c in self.indicators]]

    def filled(self) -> dict[str, Column]:
        """Inputs after the median fill, and the indicators."""
        values = {c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(self.medians[c])) for c in self.columns}
        flags = {f"missing_{c}": nan_to_null(F.col(c).cast("double")).isNull().cast("double") for c in self.indicators}
        return {**values, **flags}

    def scaled(self) -> dict[str, Column]:
        return {n: (e - F.lit(self.means.get(n, 0.0))) / F.lit(self.scales.get(n, 1.0)) for n, e in self.filled().items()}


def fit_preparations(
    df: DataFrame, columns: list[str], key: str, *, indicators: bool = False, scale: bool = True, label: str | None = None,
    hot_rows: int = HOT_ROWS, medians: Callable[[int], dict] | None = None, median_rows: int = 50_000,
) -> dict:
    """One preparation per training set named by a key column, all sets in two grouped jobs.

    For sets of more than `median_rows` rows `medians`, given the number of sets, may find their medians in another way.

    A column without any value is kept and filled with 0; a column without spread keeps scale 1.
    Mean and sd after the fill follow from those of the present values and the number of gaps.
    """
    x = df.select(
        F.col(key).alias("_set"), *([F.col(label).alias("_y")] if label else []), *[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns]
    )
    facts = x.groupBy("_set").agg(
        F.count("*").alias("_n"), (F.count_if(F.col("_y") == 1) if label else F.lit(0)).alias("_p"),
        *[e for i, c in enumerate(columns) for e in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))],
    ).collect()
    largest = max((r["_n"] for r in facts), default=0)
    if medians and largest > median_rows:
        med = medians(len(facts))
    else:
        # Where no set is large the built-in quantile needs no size check of its own.
        ways = {"hot_rows": hot_rows if largest > rows_allowed(hot_rows, columns) else None}
        med = {r["_set"]: {c: r[f"{c}_m"] for c in columns} for r in exact_quantiles(x, ["_set"], columns, {"m": 0.5}, **ways).collect()}
    out = {}
    for r in facts:
        n = r["_n"]
        prep = Preparation(list(columns), {}, rows=n, positives=r["_p"])
        for i, c in enumerate(columns):
            present, fill = r[f"n{i}"], med[r["_set"]][c]
            fill = float(fill) if fill is not None else 0.0
            prep.medians[c] = fill
            gaps = n - present
            if indicators and gaps:
                prep.indicators.append(c)
            if scale:
                m, v = (float(r[f"m{i}"]), float(r[f"v{i}"])) if present else (0.0, 0.0)
                mean = (present * m + gaps * fill) / n
                spread = math.sqrt((present * (v + (m - mean) ** 2) + gaps * (fill - mean) ** 2) / n)
                prep.set_scale(c, mean, spread)
                prep.set_scale(f"missing_{c}", gaps / n, math.sqrt(gaps / n * (1 - gaps / n)))
        out[r["_set"]] = prep
    return out


def fit_preparation(
    train: DataFrame, columns: list[str], *, indicators: bool = False, scale: bool = True, label: str | None = None, hot_rows: int = HOT_ROWS
) -> Preparation:
    """Learn medians, indicator columns, means and population sds from training rows."""
    one = train.withColumn("_one", F.lit(0))
    return fit_preparations(one, columns, "_one", indicators=indicators, scale=scale, label=label, hot_rows=hot_rows)[0]


def impute_median(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    return df.withColumns(fit_preparation(df, columns, scale=False, **kw).filled())


def missing_indicators(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    prep = fit_preparation(df, columns, indicators=True, scale=False, **kw)
    return df.withColumns({n: e for n, e in prep.filled().items() if n.startswith("missing_")})


def standard_scale(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    return df.withColumns(fit_preparation(df, columns, **kw).scaled())


def detect_categorical(df: DataFrame) -> tuple[list[str], list[str]]:
    """Text and boolean columns, and the rest."""
    cat = [n for n, t in df.dtypes if t in ("string", "boolean")]
    return cat, [n for n, _ in df.dtypes if n not in cat]


def most_frequent(df: DataFrame, column: str) -> str | None:
    """Most frequent value; among equals the first in order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    row = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("b")).first()
    return row["b"]["v"] if row["b"] is not None else None


def categorical_encode(train: DataFrame, df: DataFrame, column: str, out: str) -> tuple[DataFrame, list[str]]:
    """Most-frequent fill and one-hot array in level order; levels unseen in training give zeros."""
    fill = most_frequent(train, column)
    filled_train = train.select(F.coalesce(F.col(column), F.lit(fill)).alias(column))
    filled = df.withColumn(column, F.coalesce(F.col(column), F.lit(fill)))
    indexer = StringIndexer(inputCol=column, outputCol="_i", handleInvalid="keep", stringOrderType="alphabetAsc").fit(filled_train)
    indexed = indexer.transform(filled)
    encoder = OneHotEncoder(inputCol="_i", outputCol="_v", dropLast=True).fit(indexer.transform(filled_train))
    coded = encoder.transform(indexed).withColumn(out, vector_to_array("_v")).drop("_i", "_v")
    return coded, list(indexer.labels)
