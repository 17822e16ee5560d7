"""Counts, summaries and comparisons over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import METRICS
from ..functions.derive import interval_bin
from ..functions.parsing import nan_to_null
from .ordered import HOT_ROWS, exact_quantiles


def value_counts(df: DataFrame, value: Column, missing: str = "<MISSING>") -> DataFrame:
    return df.groupBy(F.coalesce(value.cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def five_number_summary(df: DataFrame, col: str, keys: list[str] = [], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, minimum, quartiles and maximum over finite values, whole table or per group."""
    x = df.select(*keys, nan_to_null(F.col(col).cast("double")).alias("v"))
    ends = x.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    mid = exact_quantiles(x, keys, ["v"], {"p25": 0.25, "median": 0.5, "p75": 0.75}, hot_rows=hot_rows)
    mid = mid.select(*keys, F.col("v_p25").alias("p25"), F.col("v_median").alias("median"), F.col("v_p75").alias("p75"))
    return ends.join(mid, keys, "left") if keys else ends.withColumn("_k", F.lit(1)).join(mid.withColumn("_k", F.lit(1)), "_k").drop("_k")


def distribution_by_type(df: DataFrame, kind: str, entity: str, duration: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per record type: records, distinct entities and five-number duration."""
    counts = df.groupBy(kind).agg(F.count("*").alias("record_count"), F.countDistinct(entity).alias("entity_count"))
    return counts.join(five_number_summary(df, duration, [kind], hot_rows=hot_rows).drop("n"), kind)


def interval_bins(df: DataFrame, days: str) -> DataFrame:
    """Events in each follow-up band."""
    band = interval_bin(F.col(days))
    names = ["le_90d", "d91_180", "d181_365", "d366_730", "gt_730d"]
    return df.agg(*[F.count_if(band == n).alias(n) for n in names])


def state_crosstab(df: DataFrame, row: str, state: str, states: list[str]) -> DataFrame:
    """Rows by state counts, zero-filled, one column for every listed state."""
    return df.groupBy(row).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])


def flow_table(df: DataFrame, stages: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """Stage rows (order, name, kept, excluded, reason) from one pass over the table."""
    counts = df.agg(
        *[F.count_if(keep).alias(f"k{i}") for i, (_, keep, _, _) in enumerate(stages)],
        *[F.count_if(drop).alias(f"d{i}") for i, (_, _, drop, _) in enumerate(stages)],
    )
    rows = [
        F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"k{i}").alias("n"),
                 F.col(f"d{i}").alias("excluded_n"), F.lit(reason).alias("reason"))
        for i, (name, _, _, reason) in enumerate(stages)
    ]
    return counts.select(F.inline(F.array(*rows)))


def missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count per column, one row per column, one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "missing")


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """Occurrences of every code in `;`-joined reason texts."""
    codes = df.select(F.explode(F.split(reasons, ";")).alias("reason"))
    return codes.filter(F.col("reason") != "").groupBy("reason").agg(F.count("*").alias("n"))


def mean_prediction_pivot(oof: DataFrame, models: list[str]) -> DataFrame:
    """Mean probability of each model per entity, one column per model."""
    return oof.groupBy("entity_id", "label").agg(
        *[F.avg(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models]
    )


def metric_distribution(runs: DataFrame, keys: list[str], metric: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Spread of one metric over runs: n, mean, sample sd, extremes and central 95%."""
    x = runs.select(*keys, nan_to_null(F.col(metric)).alias("v")).filter(F.col("v").isNotNull())
    basic = x.groupBy(*keys).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = exact_quantiles(x, keys, ["v"], {"p2_5": 0.025, "median": 0.5, "p97_5": 0.975}, hot_rows=hot_rows)
    return basic.join(q.withColumnsRenamed({"v_p2_5": "p2_5", "v_median": "median", "v_p97_5": "p97_5"}), keys)


def repeated_summary(runs: DataFrame, metrics: list[str] = METRICS, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nine statistics (population sd) of every metric per model, long layout."""
    long = runs.unpivot(["model"], metrics, "metric", "v").withColumn("v", nan_to_null(F.col("v")))
    basic = long.groupBy("model", "metric").agg(
        F.count("*").alias("seed_count"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = exact_quantiles(long, ["model", "metric"], ["v"], {"p2_5": 0.025, "p25": 0.25, "median": 0.5, "p75": 0.75, "p97_5": 0.975}, hot_rows=hot_rows)
    names = {f"v_{n}": n for n in ("p2_5", "p25", "median", "p75", "p97_5")}
    return basic.join(q.withColumnsRenamed(names), ["model", "metric"])


def repeated_summary_wide(summary: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """One row per model, a column for every metric and statistic."""
    stats = ["mean", "std", "min", "p2_5", "p25", "median", "p75", "p97_5", "max"]
    return summary.groupBy("model").agg(
        F.max("seed_count").alias("seed_count"),
        *[F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in stats],
    )


def paired_difference(runs: DataFrame, metric: str, new: str, base: str) -> DataFrame:
    """Per-seed difference of a metric between two models, one row per seed."""
    side = runs.groupBy("seed").agg(
        F.max(F.when(F.col("model") == new, F.col(metric))).alias("new"),
        F.max(F.when(F.col("model") == base, F.col(metric))).alias("base"),
    )
    return side.select("seed", (F.col("new") - F.col("base")).alias("delta"))


def paired_summary(deltas: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distribution of the differences and how many seeds are higher, equal or lower."""
    one = deltas.withColumn("_k", F.lit(1))
    counts = one.groupBy("_k").agg(
        F.count_if(F.col("delta") > 0).alias("higher"), F.count_if(F.col("delta") == 0).alias("equal"),
        F.count_if(F.col("delta") < 0).alias("lower"),
    )
    return metric_distribution(one, ["_k"], "delta", hot_rows=hot_rows).join(counts, "_k").drop("_k")


def selection_frequency(folds: DataFrame, col: str = "selected_recipe") -> DataFrame:
    return folds.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def numeric_differences(new: DataFrame, old: DataFrame, key: str, features: list[str], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per feature: matched pairs, absolute differences, correlation and a match class."""
    rows = value_differences(new, old, key, features)
    gap = F.col("absolute_difference")
    near = gap <= 1e-8 + 1e-6 * F.abs(F.col("old_value"))
    base = rows.groupBy("feature").agg(
        F.count(gap).alias("matched"),
        F.count_if(gap.isNull()).alias("missing"),
        F.avg(gap).alias("mean_abs_diff"),
        F.max(gap).alias("max_abs_diff"),
        F.corr(F.when(gap.isNotNull(), F.col("new_value")), F.when(gap.isNotNull(), F.col("old_value"))).alias("correlation"),
        F.count_if(gap <= 1e-12).alias("exact_match"),
        F.when(F.count(gap) == 0, "DIFFERENT").when(F.max(gap) <= 1e-12, "EXACT")
        .when(F.bool_and(near), "NEAR").otherwise("DIFFERENT").alias("comparison_class"),
    )
    mid = exact_quantiles(rows.filter(gap.isNotNull()), ["feature"], ["absolute_difference"], {"m": 0.5}, hot_rows=hot_rows)
    return base.join(mid.withColumnRenamed("absolute_difference_m", "median_abs_diff"), "feature", "left")


def value_differences(new: DataFrame, old: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Long table of paired values with their absolute difference and status."""
    a = new.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "new_value")
    b = old.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "old_value")
    x, y = nan_to_null(F.col("new_value")), nan_to_null(F.col("old_value"))
    gap = F.abs(x - y)
    return a.join(b, [key, "feature"], "full").select(
        key, "feature", x.alias("new_value"), y.alias("old_value"), gap.alias("absolute_difference"),
        F.when(x.isNull(), "MISSING_NEW").when(y.isNull(), "MISSING_OLD").when(gap <= 1e-12, "MATCH")
        .otherwise("DIFFERENT").alias("comparison_status"),
    )


def constant_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns with at most one distinct finite value."""
    finite = {c: nan_to_null(F.col(c).cast("double")) for c in cols}
    ends = df.agg(*[F.min(x).alias(f"lo_{c}") for c, x in finite.items()], *[F.max(x).alias(f"hi_{c}") for c, x in finite.items()])
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.lit(True)).alias("constant"))
        for c in cols
    ]
    return ends.select(F.inline(F.array(*rows)))


def rank_candidates(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Candidates from best to worst by several scores, ties by name."""
    return df.orderBy(*[F.desc(c) for c in by], F.asc(name))


def best_by_score(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """Highest score per group; among equal scores the first name.  One combining aggregate, no sort."""
    pick = F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("_p")
    return df.groupBy(*keys).agg(pick).select(*keys, F.col("_p.n").alias(name), (-F.col("_p.s")).alias(score))


def top_features(df: DataFrame, score: str, name: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(name)).limit(n)
