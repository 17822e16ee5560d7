"""Per-entity aggregation of window tables: five statistics, counts, sums and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BURDEN_THRESHOLD, SUCCESS
from ..functions.derive import first_reason
from ..functions.parsing import nan_to_null
from ..session import cut_lineage
from .ordered import HOT_ROWS, exact_quantiles, hot_groups, join_by_keys, rows_allowed

STAT_QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
COUNTERS = ["raw_rpeak_count", "raw_rr_count", "valid_rr_count", "removed_rr_count"]


def success_mask(df: DataFrame) -> Column:
    """Success of a window from the best column at hand."""
    if "extraction_success" in df.columns:
        return F.coalesce(F.col("extraction_success"), F.lit(False))
    if "window_status" in df.columns:
        return F.coalesce(F.upper("window_status") == SUCCESS, F.lit(False))
    if "read_success" in df.columns:
        return F.coalesce(F.col("read_success"), F.lit(False))
    return F.lit(True)


def qc_mask(df: DataFrame) -> Column:
    return F.coalesce(F.col("qc_valid"), F.lit(False)) if "qc_valid" in df.columns else success_mask(df)


def value_mask(df: DataFrame, feature: str) -> Column:
    """Value is finite and its validity bit, where there is one, is set."""
    finite = nan_to_null(F.col(feature)).isNotNull()
    bit = f"{feature}_valid"
    return finite & F.coalesce(F.col(bit), F.lit(False)) if bit in df.columns else finite


def usable_values(df: DataFrame, keys: list[str], features: list[str], mask: Column, keep: list[str] = []) -> DataFrame:
    """Feature values that pass the row mask and their own validity, others null; `keep` columns as they are."""
    return df.select(*keys, *keep, *[F.when(mask & value_mask(df, f), F.col(f)).alias(f) for f in features])


def five_stats(
    values: DataFrame, keys: list[str], features: list[str], *, extra: list[Column] = [], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean, sample sd (0 for one value), p10, p50, p90 and count of every feature per group.

    Without large groups everything is one aggregate.  Otherwise mean, sd and count still combine
    before the shuffle and only the quantiles split the large groups.  `extra` aggregates join
    the same pass.
    """
    moments = list(extra)
    for f in features:
        n = F.count(f)
        moments += [
            F.avg(f).alias(f"{f}_mean"),
            F.when(n > 1, F.stddev_samp(f)).when(n == 1, F.lit(0.0)).alias(f"{f}_std"),
            n.alias(f"{f}_valid_count"),
        ]
    if hot_groups(values, keys, rows_allowed(hot_rows, features)).isEmpty():
        ps = F.array(*[F.lit(p) for p in STAT_QUANTILES.values()])
        one = values.groupBy(*keys).agg(*moments, *[F.percentile(F.col(f), ps).alias(f"_q_{f}") for f in features])
        quantiles = [F.col(f"_q_{f}")[i].alias(f"{f}_{n}") for f in features for i, n in enumerate(STAT_QUANTILES)]
        return one.select(*[c for c in one.columns if not c.startswith("_q_")], *quantiles)
    values = cut_lineage(values)  # moments, bounds and buckets read them again
    basic = values.groupBy(*keys).agg(*moments)
    return join_by_keys(basic, exact_quantiles(values, keys, features, STAT_QUANTILES, hot_rows=hot_rows), keys, "left")


def count_columns(df: DataFrame) -> list[Column]:
    """Aggregates for theoretical, successful and quality-valid windows, success rate and counter sums."""
    ok, qc = success_mask(df), qc_mask(df)
    sums = [
        (F.coalesce(F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).cast("double") if c in df.columns
         else F.lit(0.0)).alias(f"{c}_total")
        for c in COUNTERS
    ]
    return [
        F.count("*").alias("n_windows_theoretical"),
        F.count_if(ok).alias("n_windows_successful"),
        F.count_if(qc).alias("n_windows_qc_valid"),
        (F.count_if(ok) / F.count("*")).alias("window_success_rate"),
        *sums,
    ]


def window_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*count_columns(df))


def first_by_window(df: DataFrame, keys: list[str], cols: list[str], order: str = "window_id") -> DataFrame:
    """First non-null value of each column in window order."""
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    )


def burden_ratio(
    windows: DataFrame, external: DataFrame, keys: list[str], count: str = "pvc_count_24h", *, threshold: float = BURDEN_THRESHOLD
) -> DataFrame:
    """External event count over beats detected in covered windows, with a status for every gap."""
    beats = windows.groupBy(*keys).agg(covered_beats(windows))
    return burden_columns(external.join(beats, keys, "left"), keys, count, threshold=threshold)


def covered_beats(windows: DataFrame) -> Column:
    """Aggregate of the beats detected in covered windows."""
    covered = F.coalesce(F.col("read_success"), F.lit(False)) if "read_success" in windows.columns else success_mask(windows)
    beats = F.when(covered, nan_to_null(F.col("raw_rpeak_count").cast("double")))
    return F.coalesce(F.sum(beats), F.lit(0.0)).alias("_beats")


def burden_columns(joined: DataFrame, keep: list[str], count: str = "pvc_count_24h", *, threshold: float = BURDEN_THRESHOLD) -> DataFrame:
    """Burden, flag and status from the external count and `_beats` (null without windows)."""
    c, b = nan_to_null(F.col(count).cast("double")), F.col("_beats")
    status = first_reason(
        [(c.isNull(), "UNAVAILABLE_OFFICIAL_COUNT"), (b.isNull(), "UNAVAILABLE_NO_COVERAGE"), (b <= 0, "UNAVAILABLE_NO_DETECTED_BEATS")],
        "AVAILABLE",
    )
    ratio = F.when(c.isNotNull() & (b > 0), c / b)
    return joined.select(
        *[k for k in keep if k != count],
        c.alias(count),
        F.when(c.isNotNull(), b).alias("pvc_denominator_beats"),
        ratio.alias("pvc_burden"),
        F.coalesce(ratio > threshold, F.lit(False)).alias("high_pvc_burden"),
        status.alias("pvc_burden_status"),
    )


def entity_feature_table(
    windows: DataFrame,
    features: list[str],
    *,
    subjects: DataFrame | None = None,
    metadata: list[str] | None = None,
    use_qc_valid: bool = False,
    min_qc_valid: int = 1,
    include_ineligible: bool = True,
    burden_threshold: float = BURDEN_THRESHOLD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One wide row per entity: metadata, statistics, valid counts, window counters and burden.

    Entities come from both windows and subjects, so one without windows keeps a row.
    """
    key = ["entity_id"]
    mask = qc_mask(windows) if use_qc_valid else success_mask(windows)
    flags = [c for c in ("extraction_success", "window_status", "read_success", "qc_valid", *COUNTERS) if c in windows.columns]
    with_beats = "raw_rpeak_count" in windows.columns
    values = usable_values(windows, key, features, mask, keep=flags)
    # Counts, sums, beats and statistics come from one pass over the windows.
    extra = [*count_columns(windows), *([covered_beats(windows)] if with_beats else [])]
    per_entity = five_stats(values, key, features, extra=extra, hot_rows=hot_rows)
    if subjects is None:
        out = per_entity
    else:
        wanted = [c for c in dict.fromkeys([*(metadata or []), "pvc_count_24h"]) if c in subjects.columns]
        out = per_entity.join(subjects.select("entity_id", *wanted), key, "full")
        if "pvc_count_24h" in wanted and with_beats:
            out = burden_columns(out, [c for c in out.columns if c != "_beats"], threshold=burden_threshold)
    out = out.drop("_beats")
    zero = ["n_windows_theoretical", "n_windows_successful", "n_windows_qc_valid", "window_success_rate",
            *[f"{c}_total" for c in COUNTERS], *[f"{f}_valid_count" for f in features]]
    out = out.na.fill(0, subset=zero)
    used = "n_windows_qc_valid" if use_qc_valid else "n_windows_successful"
    out = out.withColumn("n_windows_used", F.col(used))
    return out if include_ineligible else out.filter(F.col("n_windows_qc_valid") >= min_qc_valid)


def hourly_entity_table(
    windows: DataFrame, features: list[str], *, min_successful: int = 4, include_ineligible: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The fixed-schedule variant: only successful rows count, four of them at least, rate null without windows."""
    key = ["entity_id"]
    ok = success_mask(windows)
    # Only NaN and null are skipped here, infinities stay in the statistics.
    values = windows.select("entity_id", *[F.when(ok & ~F.isnan(f), F.col(f)).alias(f) for f in features])
    stats = five_stats(values, key, features, hot_rows=hot_rows).drop(*[f"{f}_valid_count" for f in features])
    out = window_counts(windows, key).drop("n_windows_qc_valid", "raw_rpeak_count_total").join(stats, key, "left")
    out = out.withColumn("n_windows_used", F.col("n_windows_successful"))
    return out if include_ineligible else out.filter(F.col("n_windows_successful") >= min_successful)
