"""Complete windows over a live stream: time windows that the watermark has closed, and sample windows that are all there.

Both are extensions of the schedule for finished records.  `window_aggregates` cuts by time stamps and lets a window go
once the watermark has passed it.  `complete_sample_windows` cuts by sample numbers and lets a window go as soon as its
last missing sample has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parsing import nan_to_null
from ..operators.windows import place_samples, usable_rate

KEYS = ["entity_id", "window_id"]
WINDOW = [*KEYS, "fs", "requested_samples"]
STATE = "samples binary"
#: Windows of at most so many samples share states, so many of them; longer ones have states of their own. They set the speed, not the result.
SHORT, STATES = 10_000, 1_024
#: Position of the row that stands for a window that has left.
LEFT = -1


def window_aggregates(
    events: DataFrame, *, time: str = "ts", entity: str = "user_id", value: str = "value", length: str = "300 seconds",
    offset: str = "60 seconds", lateness: str = "600 seconds",
) -> DataFrame:
    """Count, mean, population sd and range per entity and window; works on batch and stream alike."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    w = F.window(time, length, length, offset)
    v = F.col(value)
    return marked.groupBy(F.col(entity).alias("entity_id"), w.alias("w")).agg(
        F.count(v).alias("n"), F.avg(v).alias("sig_mean"), F.stddev_pop(v).alias("sig_std"), (F.max(v) - F.min(v)).alias("sig_p2p")
    ).select("entity_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sig_mean", "sig_std", "sig_p2p")


def _first_of_each(rows: pd.DataFrame) -> pd.DataFrame:
    """One sample of each position of a window: the earliest, of equally early ones null (NaN) before the smallest."""
    at = rows["at"].to_numpy(np.int64)
    value = rows["value"].to_numpy(float)
    ordered = rows.iloc[np.lexsort((np.where(np.isnan(value), -np.inf, value), at))]
    return ordered.drop_duplicates([*WINDOW, "pos"])


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def complete_sample_windows(
    samples: DataFrame, *, first: int = 60, stride: int = 300, length: int = 300, rounding: str = "nearest",
    time: str = "ts", lateness: str = "600 seconds", span: float | None = None,
) -> DataFrame:
    """Windows of samples (`entity_id, sample_idx, value, fs` and a time stamp) of which every sample has come.

    Returns entity_id, window_id, fs, requested_samples and `values`, the samples in order as an array of doubles.  On a
    stream each window leaves once, in the batch that brings its last missing sample; windows with gaps never leave.

    A state holds the open windows of one part of all (entity, window) pairs, or one window alone where windows are long, so
    a long or hot record spreads over its windows.  A window is forgotten once the watermark is `span` seconds (by default
    the window's length) past its latest sample; rows later than the watermark (`lateness`) are dropped.

    A sample that comes again changes nothing.  Among repeats in one batch the earliest counts, among equally early ones
    null before the smallest value.  Null, NaN and infinite values count as samples and are null in `values`.  Rows without
    an entity, a sample number, a time stamp or a usable rate belong to no window.
    """
    rate = usable_rate(F.col("fs"))
    usable = samples.filter(F.col("entity_id").isNotNull() & F.col("sample_idx").isNotNull() & F.col(time).isNotNull() & rate.isNotNull())
    if usable.isStreaming:
        usable = usable.withWatermark(time, lateness)
    usable = usable.withColumns({"fs": F.col("fs").cast("double"), "value": nan_to_null(F.col("value").cast("double"))})
    placed = place_samples(usable, first=first, stride=stride, length=length, rounding=rounding, keep=(time,))
    if not placed.isStreaming:
        one = placed.groupBy(*KEYS, "fs", "requested_samples", "pos").agg(F.min(F.struct(time, "value")).alias("s"))
        whole = one.groupBy(*KEYS, "fs", "requested_samples").agg(F.sort_array(F.collect_list(F.struct("pos", "s.value"))).alias("s"))
        return whole.filter(F.size("s") == F.col("requested_samples")).select(*KEYS, "fs", "requested_samples", F.col("s.value").alias("values"))

    kept_ms = int(1000 * (length if span is None else span))

    def collect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
        if state.hasTimedOut:
            rows = kept
        else:
            came = latest = None
            for frame in frames:  # of repeated samples only one stays
                came = _first_of_each(frame if came is None else pd.concat([came, frame]))
                last = frame.groupby(WINDOW, sort=False)["ms"].max()
                latest = last if latest is None else pd.concat([latest, last]).groupby(level=WINDOW, sort=False).max()
            new = came[[*WINDOW, "pos", "value"]].assign(until=np.int64(0))
            rows = new if kept is None else pd.concat([kept, new], ignore_index=True).drop_duplicates([*WINDOW, "pos"])
            rows = rows.reset_index(drop=True)
            heard = rows[WINDOW].merge(latest.rename("ms").reset_index(), on=WINDOW, how="left")["ms"].to_numpy(float)
            again = ~np.isnan(heard)
            until = rows["until"].to_numpy(np.int64).copy()
            until[again] = np.maximum(heard[again].astype(np.int64) + kept_ms, now + 1)
            rows = rows.assign(until=until)
            code = rows.groupby(WINDOW, sort=False).ngroup().to_numpy()
            pos, size = rows["pos"].to_numpy(np.int64), rows["requested_samples"].to_numpy(np.int64)
            gone = np.bincount(code, pos == LEFT)[code] > 0
            whole = ~gone & (np.bincount(code)[code] == size)
            if whole.any():
                done = rows[whole].assign(code=code[whole]).sort_values(["code", "pos"])
                heads = done.drop_duplicates("code")
                value = done["value"].to_numpy(float)
                listed = value.astype(object)
                listed[np.isnan(value)] = None
                edges = np.cumsum(heads["requested_samples"].to_numpy(np.int64))[:-1]
                yield heads[WINDOW].assign(values=[v.tolist() for v in np.split(listed, edges)])
                rows.loc[heads.index, ["pos", "value"]] = [LEFT, np.nan]
                pos = rows["pos"].to_numpy(np.int64)
            stays = (pos == LEFT) | ~(gone | whole)
            rows = rows[stays]
        rows = rows[rows["until"] >= max(now, 0)]
        if len(rows):
            state.update((_packed(rows),))
            state.setTimeoutTimestamp(int(max(rows["until"].min(), now + 1)))
        elif state.exists:
            state.remove()

    entity = placed.schema["entity_id"].dataType.simpleString()
    rows = placed.withColumns({"at": F.unix_micros(F.col(time).cast("timestamp")), "ms": F.unix_millis(F.col(time).cast("timestamp"))})
    place = F.xxhash64(*WINDOW)
    shared = F.when(F.col("requested_samples") <= SHORT, F.pmod(place, F.lit(STATES))).otherwise(place)
    return rows.select(*WINDOW, "pos", "value", "at", "ms", time).withColumn("state", shared).groupBy("state").applyInPandasWithState(
        collect, f"entity_id {entity}, window_id long, fs double, requested_samples long, values array<double>", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
