"""Fixed complete windows over finished records: schedules, assignment and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    EMPTY_SIGNAL, FEATURE_ERROR, HOURLY_SCHEDULE, OUTSIDE_RECORD, READ_ERROR, SHORT_READ, SUCCESS,
)
from ..functions.derive import first_reason
from ..functions.parsing import nan_to_null
from .relational import BROADCAST_ROWS


INVALID_RATE = "INVALID_RATE"
#: Samples of one record that meet its row in one piece where records are too many to broadcast.
BLOCK_SAMPLES = 1 << 20
#: How bounds in seconds become sample numbers: nearest (even on ties), or cut.
ROUNDINGS = {"nearest": F.bround, "cut": F.floor}


def usable_rate(fs: Column) -> Column:
    """The sampling rate where it is finite and positive, else null."""
    return F.when(nan_to_null(fs.cast("double")) > 0, fs)


def schedule_status(records: DataFrame) -> DataFrame:
    """Records with `schedule_status`: SUCCESS, or INVALID_RATE for a record that can have no window."""
    return records.withColumn("schedule_status", F.when(usable_rate(F.col("fs")).isNotNull(), SUCCESS).otherwise(INVALID_RATE))


def window_count(duration: Column, first: int = 60, stride: int = 300, length: int = 300) -> Column:
    """Complete windows that fit a duration in seconds."""
    fitting = F.floor((duration - first - length) / F.lit(float(stride)) + 1e-9) + 1
    return F.when(duration + 1e-9 >= first + length, fitting).otherwise(F.lit(0)).cast("long")


def tail_seconds(duration: Column, first: int = 60, stride: int = 300, length: int = 300) -> Column:
    """Remainder after the last complete window; the whole duration if none fits."""
    n = window_count(duration, first, stride, length)
    end = F.lit(first + length) + (n - 1) * stride
    return F.greatest(F.when(n > 0, duration - end).otherwise(duration), F.lit(0.0))


def hourly_count(duration: Column) -> Column:
    """Audit rule: two-minute windows at 60 s and every hour after it, at most 24."""
    n = F.floor((duration + 1e-9 - 180) / F.lit(3600.0)) + 1
    return F.coalesce(F.when(duration + 1e-9 >= 180, F.least(n, F.lit(24))), F.lit(0)).cast("long")


def from_zero_count(duration: Column) -> Column:
    """Audit rule: five-minute windows counted from the record start."""
    return F.coalesce(F.when(duration >= 300, F.floor((duration + 1e-9) / 300)), F.lit(0)).cast("long")


def _bounds(df: DataFrame, length: int, rounding) -> DataFrame:
    fs = F.col("fs")
    return df.withColumns(
        {
            "end_sec": F.col("start_sec") + length,
            "start_sample": rounding(F.col("start_sec") * fs).cast("long"),
            "requested_samples": rounding(F.lit(length) * fs).cast("long"),
        }
    ).withColumn("end_sample", F.col("start_sample") + F.col("requested_samples"))


def complete_windows(records: DataFrame, *, first: int = 60, stride: int = 300, length: int = 300) -> DataFrame:
    """Every complete window of each record (`entity_id, fs, sample_count`); a record without a usable rate has none."""
    duration = F.try_divide("sample_count", usable_rate(F.col("fs")))
    counted = records.withColumn("_n", window_count(duration, first, stride, length)).filter("_n > 0")
    rows = counted.withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    return _bounds(rows.withColumn("start_sec", F.lit(first) + F.col("window_id") * stride), length, F.bround)


def hourly_windows(
    records: DataFrame, *, first: int = HOURLY_SCHEDULE["first"], stride: int = HOURLY_SCHEDULE["stride"],
    length: int = HOURLY_SCHEDULE["length"], count: int = HOURLY_SCHEDULE["count"],
) -> DataFrame:
    """A fixed number of starts per record, kept even outside it; sample bounds are cut, not rounded."""
    rows = records.withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return _bounds(rows.withColumn("start_sec", F.lit(first) + F.col("window_id") * stride), length, F.floor)


def assign_windows(
    samples: DataFrame, records: DataFrame, *, first: int = 60, stride: int = 300, length: int = 300,
    rounding: str = "nearest", count: int | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Samples (`entity_id, sample_idx, value`) with their window and position in it.

    The window number is arithmetic on the sample number, so no range join is needed;
    samples outside every window are dropped.  Without `count` the windows are the complete
    ones of the record, with it a fixed number of starts, complete or not; `rounding="cut"`
    and a count feed the fixed hourly schedule.  Records without a usable rate have no window.

    Records up to `broadcast_rows` travel to the samples; more of them meet the samples by
    entity and block of samples, so a long recording is never one task.
    """
    usable = records.withColumn("fs", usable_rate(F.col("fs"))).filter("fs is not null")
    n = window_count(F.try_divide("sample_count", "fs"), first, stride, length) if count is None else F.lit(count).cast("long")
    side = usable.select("entity_id", "fs", n.alias("_n"), F.col("sample_count").alias("_samples"))
    if side.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = samples.join(F.broadcast(side), "entity_id")
    else:
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.coalesce(F.greatest("_samples", F.lit(0)), F.lit(0)) / BLOCK_SAMPLES))).alias("_block")
        numbered = samples.withColumn("_block", F.floor(F.col("sample_idx") / BLOCK_SAMPLES))
        joined = numbered.join(side.select("entity_id", "fs", "_n", blocks), ["entity_id", "_block"])
    return place_samples(joined, F.col("_n"), first=first, stride=stride, length=length, rounding=rounding)


def place_samples(
    samples: DataFrame, count: Column | None = None, *, first: int = 60, stride: int = 300, length: int = 300,
    rounding: str = "nearest", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Samples that carry their own `fs`, with the window and the position in it; further columns to `keep` come along.

    Only windows 0 to `count` - 1 are used, without a count all from 0 on.  Works on batch and stream alike.
    """
    rounded = ROUNDINGS[rounding]
    fs, idx = F.col("fs"), F.col("sample_idx")

    def start(k: Column) -> Column:
        return rounded((F.lit(first) + k * stride) * fs).cast("long")

    size = rounded(F.lit(length) * fs).cast("long")

    def holds(k: Column) -> Column:
        known = k >= 0 if count is None else (k >= 0) & (k < count)
        return known & (start(k) <= idx) & (idx < start(k) + size)

    k0 = F.floor(((idx + 0.5) / fs - first) / F.lit(float(stride)))
    whole = F.when(holds(k0), F.array(k0)).otherwise(F.array().cast("array<bigint>"))
    # A fractional rate may round two windows onto one shared sample.
    shared = F.filter(F.array(k0 - 1, k0, k0 + 1), holds)
    ks = F.when(fs == F.floor(fs), whole).otherwise(shared)
    # The filter drops nothing; stating it here keeps every later branch on one and the same shuffle.
    placed = samples.withColumn("window_id", F.explode(ks)).filter(F.col("window_id").isNotNull())
    return placed.select(
        "entity_id", "window_id", (idx - start(F.col("window_id"))).alias("pos"), "value", "fs", size.alias("requested_samples"), *keep
    )


def window_status(theoretical: DataFrame, assigned: DataFrame) -> DataFrame:
    """Status of every theoretical window from its samples; failing windows stay as rows."""
    counts = assigned.groupBy("entity_id", "window_id").agg(
        F.count("*").alias("n_samples"), F.count(nan_to_null(F.col("value").cast("double"))).alias("n_finite")
    )
    return status_from_counts(theoretical, counts).drop("n_samples")


def status_from_counts(theoretical: DataFrame, counts: DataFrame) -> DataFrame:
    """Status from a table that holds `n_samples` per window, null or not, and `n_finite` of them; its other columns come along.

    A complete window that holds a null or non-finite sample is read, but has no features: FEATURE_ERROR.
    """
    joined = theoretical.join(counts, ["entity_id", "window_id"], "left")
    actual = F.coalesce(F.col("n_samples"), F.lit(0))
    inside = (F.col("start_sample") >= 0) & (F.col("end_sample") <= F.col("sample_count"))
    unread = ~F.col("read_ok") if "read_ok" in theoretical.columns else F.lit(False)
    status = first_reason(
        [
            (~inside, OUTSIDE_RECORD),
            (unread, READ_ERROR),
            (actual == 0, EMPTY_SIGNAL),
            (actual != F.col("requested_samples"), SHORT_READ),
            (F.coalesce(F.col("n_finite"), F.lit(0)) != actual, FEATURE_ERROR),
        ],
        SUCCESS,
    )
    return joined.withColumns(
        {
            "actual_samples": F.when(inside, actual).otherwise(F.lit(0)),
            "window_status": status,
            "read_success": status.isin(SUCCESS, FEATURE_ERROR),
            "extraction_success": status == SUCCESS,
            "failure_reason": F.when(status == SUCCESS, "").otherwise(status),
        }
    ).drop("n_finite")
