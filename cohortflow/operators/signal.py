"""Features of one window of samples or intervals.

Input is long: `entity_id, window_id, pos, value, fs`.  All steps group or order by
(entity, window), whose size the schedule fixes, so one hash partitioning serves
every step and a large entity spreads over its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    AF_INCOMPATIBLE_HRV, INSUFFICIENT_VALID_NN, INTERVAL_FEATURES, INTERVAL_MAX_SEC, INTERVAL_MIN_SEC,
    INTERVAL_TOLERANCE, INVALID_RR_RATIO, MAX_REMOVED_RATIO, MIN_VALID_INTERVALS, PEAK_PERCENTILE,
    PEAK_SPACING_SEC, WINDOW_FEATURES,
)
from ..functions.derive import reason_list
from ..functions.parsing import nan_to_null
from ..session import cut_lineage

KEYS = ["entity_id", "window_id"]


def center_scale(samples: DataFrame) -> DataFrame:
    """Subtract the window median and divide by the population sd where it exceeds 1e-8."""
    whole = Window.partitionBy(*KEYS)
    v = F.col("value")
    med = F.percentile(v, F.lit(0.5)).over(whole)
    sd = F.stddev_pop(v).over(whole)
    parts = samples.withColumns({"_med": med, "_sd": sd})
    scaled = (v - F.col("_med")) / F.when(F.col("_sd") > 1e-8, F.col("_sd")).otherwise(F.lit(1.0))
    return parts.withColumn("value", scaled).drop("_med", "_sd")


def signal_moments(samples: DataFrame) -> DataFrame:
    """Mean, population sd, range, unbiased skew and unbiased excess kurtosis per window."""
    v = F.col("value")
    n = F.count(v).cast("double")
    sd = F.stddev_pop(v)
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(v)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6)
    return samples.groupBy(*KEYS).agg(
        F.avg(v).alias("sig_mean"),
        sd.alias("sig_std"),
        (F.max(v) - F.min(v)).alias("sig_p2p"),
        F.when((n >= 3) & (sd > 0), skew).alias("sig_skew"),
        F.when((n > 3) & (sd > 0), kurt).alias("sig_kurt"),
        F.count("*").alias("n_samples"),
        F.count(v).alias("n_finite"),
        F.first("fs").alias("fs"),
    )


def peak_candidates(samples: DataFrame) -> DataFrame:
    """Local maxima of the squared signal at or above its 93rd percentile.

    A flat top counts as one maximum at its middle sample; the window edges never count.
    """
    order = Window.partitionBy(*KEYS).orderBy("pos")
    squared = samples.select(*KEYS, "pos", "fs", (F.col("value") * F.col("value")).alias("h"))
    leveled = squared.withColumns(
        {"_p": F.lag("h").over(order), "_min": F.percentile("h", F.lit(PEAK_PERCENTILE)).over(Window.partitionBy(*KEYS))}
    )
    # Only the first sample of a run of equal values is kept, so the neighbours differ.
    runs = leveled.filter(F.col("_p").isNull() | (F.col("_p") != F.col("h")))
    ends = runs.withColumns({"_n": F.lead("h").over(order), "_np": F.lead("pos").over(order)})
    top = (F.col("_p") < F.col("h")) & (F.col("_n") < F.col("h")) & (F.col("h") >= F.col("_min"))
    return ends.filter(top).select(*KEYS, F.floor((F.col("pos") + F.col("_np") - 1) / 2).alias("pos"), "h", "fs")


def space_peaks(candidates: DataFrame, *, spacing_sec: float = PEAK_SPACING_SEC) -> DataFrame:
    """Keep a candidate unless a higher kept one lies closer than the spacing; of equal heights the later wins.

    Candidates further apart than the spacing cannot affect each other, so the rule
    runs inside short chains of close candidates.
    """
    order = Window.partitionBy(*KEYS).orderBy("pos")
    apart = F.greatest(F.floor(F.lit(spacing_sec) * F.col("fs")), F.lit(1))
    gapped = candidates.withColumn("_far", F.coalesce(F.col("pos") - F.lag("pos").over(order) >= apart, F.lit(True)))
    chained = gapped.withColumn("_chain", F.sum(F.col("_far").cast("int")).over(order))
    chains = chained.groupBy(*KEYS, "_chain").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("h")).alias("h"), (-F.col("pos")).alias("p")))).alias("_c"),
        F.first("fs").alias("fs"),
    )
    kept = F.aggregate(
        "_c",
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k + x["p"]) < apart), acc).otherwise(
            F.array_append(acc, -x["p"])
        ),
    )
    return chains.select(*KEYS, F.explode(kept).alias("pos"), "fs")


def detect_peaks(samples: DataFrame) -> DataFrame:
    return space_peaks(peak_candidates(samples))


def beat_rate(windows: DataFrame, peaks: DataFrame) -> DataFrame:
    """Peak count and rate per minute; windows (`n_samples, fs`) without peaks give zero."""
    counts = peaks.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("double")
    seconds = F.col("n_samples") / F.col("fs") + 1e-8
    return windows.join(counts, KEYS, "left").select(
        *KEYS, n.alias("beats"), F.when(F.col("n_samples") > 0, n * 60.0 / seconds).alias("beats_per_min")
    )


def interval_series(peaks: DataFrame) -> DataFrame:
    """Seconds between consecutive peaks, numbered in order."""
    order = Window.partitionBy(*KEYS).orderBy("pos")
    return (
        peaks.withColumn("rr", (F.col("pos") - F.lag("pos").over(order)) / F.col("fs"))
        .filter(F.col("rr").isNotNull())
        .withColumn("beat_no", F.row_number().over(order))
        .select(*KEYS, "beat_no", "rr")
    )


def clean_intervals(
    intervals: DataFrame, *, low: float = INTERVAL_MIN_SEC, high: float = INTERVAL_MAX_SEC,
    width: int = 5, tolerance: float = INTERVAL_TOLERANCE,
) -> DataFrame:
    """Add `valid`: inside the range and within the tolerance of the centred local median."""
    if width < 1 or width % 2 == 0:
        raise ValueError("width must be a positive odd number")
    half = width // 2
    frame = Window.partitionBy(*KEYS).orderBy("beat_no").rowsBetween(-half, half)
    rr = nan_to_null(F.col("rr"))
    local = intervals.withColumn("local_median", F.percentile(rr, F.lit(0.5)).over(frame))
    m = F.col("local_median")
    ok = rr.between(low, high) & (m > 0) & (F.abs(rr - m) / m <= tolerance + 1e-12)
    return local.withColumn("valid", F.coalesce(ok, F.lit(False)))


def interval_counts(cleaned: DataFrame) -> DataFrame:
    """Raw, valid and removed intervals per window and the removed share."""
    raw, ok = F.count("*"), F.count_if("valid")
    return cleaned.groupBy(*KEYS).agg(
        raw.alias("raw_rr_count"), ok.alias("valid_rr_count"), (raw - ok).alias("removed_rr_count"),
        ((raw - ok) / raw).alias("removed_rr_ratio"),
    )


def interval_time_domain(valid: DataFrame) -> DataFrame:
    """Six time-domain statistics; differences run over the kept list and so bridge removed rows."""
    order = Window.partitionBy(*KEYS).orderBy("beat_no")
    d = valid.withColumn("_d", F.col("rr") - F.lag("rr").over(order))
    n, mean = F.count("rr"), F.avg("rr")
    enough = n >= 3
    return d.groupBy(*KEYS).agg(
        F.when(enough, mean).alias("mean_rr"),
        F.when(enough, F.stddev_samp("rr")).alias("sdnn"),
        F.when(enough, F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rmssd"),
        F.when(enough, F.avg((F.abs("_d") > 0.05).cast("double")) * 100.0).alias("pnn50"),
        F.when(enough & (mean > 1e-8), F.lit(60.0) / mean).alias("mean_hr"),
        F.when(enough, F.stddev_pop("rr") / (mean + 1e-8)).alias("rr_cv"),
    )


def window_qc(df: DataFrame, flag: Column | None = None) -> DataFrame:
    """Quality state: a failed extraction keeps its reason, else flag, interval count and removed share decide."""
    flagged = F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False)
    reasons = reason_list(
        (flagged, AF_INCOMPATIBLE_HRV),
        (F.coalesce(F.col("valid_rr_count"), F.lit(0)) < MIN_VALID_INTERVALS, INSUFFICIENT_VALID_NN),
        (F.coalesce(F.col("removed_rr_ratio"), F.lit(0.0)) > MAX_REMOVED_RATIO, INVALID_RR_RATIO),
    )
    ok = F.coalesce(F.col("extraction_success"), F.lit(False))
    reason = F.when(ok, reasons).otherwise(F.coalesce(F.nullif(F.col("failure_reason"), F.lit("")), F.lit("READ_ERROR")))
    good = ok & (reasons == "")
    return df.withColumns(
        {"qc_valid": good, "qc_status": F.when(good, "PASS").otherwise("FAIL"), "qc_reason": reason}
    )


def interval_null_policy(df: DataFrame, flag: Column, features: list[str] = INTERVAL_FEATURES) -> DataFrame:
    """For flagged entities null the interval features and their bits and fail quality; the rest is untouched."""
    on = F.coalesce(flag, F.lit(False))
    changed: dict[str, Column] = {}
    for f in features:
        if f in df.columns:
            changed[f] = F.when(~on, F.col(f))
        if f"{f}_valid" in df.columns:
            changed[f"{f}_valid"] = F.when(on, F.lit(False)).otherwise(F.col(f"{f}_valid"))
    if "extraction_success" in df.columns:
        ok = F.coalesce(F.col("extraction_success"), F.lit(False))
        why = F.when(ok, F.lit(AF_INCOMPATIBLE_HRV)).otherwise(
            F.col("failure_reason") if "failure_reason" in df.columns else F.lit(AF_INCOMPATIBLE_HRV)
        )
        changed["qc_valid"] = F.when(on, F.lit(False)).otherwise(F.col("qc_valid"))
        changed["qc_status"] = F.when(on, F.lit("FAIL")).otherwise(F.col("qc_status"))
        changed["qc_reason"] = F.when(on, why).otherwise(F.col("qc_reason"))
    return df.withColumns(changed)


def validity_bits(df: DataFrame, features: list[str] = WINDOW_FEATURES) -> DataFrame:
    """Null non-finite features and add a bit per feature."""
    clean = {f: nan_to_null(F.col(f)) for f in features}
    return df.withColumns({**{f"{f}_valid": x.isNotNull() for f, x in clean.items()}, **clean})


def interval_table(peaks: DataFrame, *, clean: bool = True) -> DataFrame:
    """Everything the peaks of a window tell, one row per window with at least one peak.

    One ordered pass gives intervals, validity and the previous kept interval; one aggregate
    then gives counts, time-domain statistics and the kept series as an array.
    """
    order = Window.partitionBy(*KEYS).orderBy("pos")
    rr = peaks.withColumn("rr", (F.col("pos") - F.lag("pos").over(order)) / F.col("fs")).withColumn("beat_no", F.row_number().over(order))
    # The first peak has no interval; its null row leaves the local medians as they are.
    checked = clean_intervals(rr) if clean else rr.withColumn("valid", F.col("rr").isNotNull())
    kept = F.when(F.col("valid"), F.col("rr"))
    before = F.last(kept, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = checked.withColumns({"_k": kept, "_d": kept - before})
    n, mean = F.count("_k"), F.avg("_k")
    enough = n >= 3
    raw = F.count("rr")
    return steps.groupBy(*KEYS).agg(
        F.count("*").alias("raw_rpeak_count"), raw.alias("raw_rr_count"), n.alias("valid_rr_count"), (raw - n).alias("removed_rr_count"),
        F.coalesce(F.try_divide(raw - n, raw), F.lit(0.0)).alias("removed_rr_ratio"),
        F.when(enough, mean).alias("mean_rr"), F.when(enough, F.stddev_samp("_k")).alias("sdnn"),
        F.when(enough, F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rmssd"),
        F.when(enough, F.avg((F.abs("_d") > 0.05).cast("double")) * 100.0).alias("pnn50"),
        F.when(enough & (mean > 1e-8), F.lit(60.0) / mean).alias("mean_hr"),
        F.when(enough, F.stddev_pop("_k") / (mean + 1e-8)).alias("rr_cv"),
        F.sort_array(F.collect_list(F.when(F.col("valid"), F.struct("beat_no", "rr")))).alias("kept"),
    )


def window_feature_table(samples: DataFrame, theoretical: DataFrame, *, clean: bool = True) -> DataFrame:
    """One row per theoretical window: status, counters, twenty features with validity bits, quality state.

    `clean=False` gives the fixed-schedule variant, which keeps every interval.

    The samples are shuffled once, by window.  Moments, peaks and spectrum all read that one
    exchange and meet again without another; their short rows are written to the checkpoint
    folder, and status, entropies and scaling exponents work on those rows alone.
    """
    from .complexity import dfa_alpha, entropies_of
    from .spectrum import spectral_bands
    from .windows import status_from_counts

    whole = Window.partitionBy(*KEYS)
    finite = nan_to_null(F.col("value").cast("double"))
    sized = samples.withColumns({"value": finite, "_n": F.count("*").over(whole), "_f": F.count(finite).over(whole)})
    scaled = center_scale(sized)
    complete = scaled.filter((F.col("_n") == F.col("requested_samples")) & (F.col("_f") == F.col("_n")))
    # The moments need neither column; naming both keeps the shuffled rows the same for every branch, so Spark reuses them.
    every = scaled.filter((F.col("pos") >= 0) & (F.col("requested_samples") >= 0))
    core = signal_moments(every).join(interval_table(detect_peaks(complete), clean=clean), KEYS, "left")
    core = cut_lineage(core.join(spectral_bands(complete), KEYS, "left"))
    long = core.filter(F.col("valid_rr_count") >= MIN_VALID_INTERVALS)
    series = long.select(*KEYS, F.posexplode("kept.rr").alias("pos", "value"))
    table = status_from_counts(theoretical, core.drop("kept", "fs"))
    out = table.join(entropies_of(long, F.col("kept.rr")), KEYS, "left").join(dfa_alpha(series), KEYS, "left")
    ok = F.col("extraction_success")
    moments = ["sig_mean", "sig_std", "sig_p2p", "sig_skew", "sig_kurt"]
    out = out.withColumns({f: F.when(ok, F.col(f)) for f in moments})
    out = out.na.fill(0, subset=["raw_rpeak_count", "raw_rr_count", "valid_rr_count", "removed_rr_count", "removed_rr_ratio"])
    beats = F.when(ok, F.col("raw_rpeak_count").cast("double"))
    seconds = F.col("n_samples") / F.col("fs") + 1e-8
    out = out.withColumns({"beats": beats, "beats_per_min": beats * 60.0 / seconds}).drop("n_samples")
    return window_qc(validity_bits(out))


def split_manifest_features(table: DataFrame, features: list[str] = WINDOW_FEATURES) -> tuple[DataFrame, DataFrame]:
    """One wide window table as a window manifest and a feature table over the same keys."""
    bits = [f"{f}_valid" for f in features if f"{f}_valid" in table.columns]
    manifest = table.drop(*features, *bits).withColumn("valid", F.col("extraction_success"))
    values = table.select(*KEYS, F.col("extraction_success").alias("valid"), "qc_valid", "qc_status", "qc_reason", *features, *bits)
    return manifest, values
