import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import complexity, signal, spectrum, windows

K = ["entity_id", "window_id"]


@pytest.mark.parametrize("duration,starts,tail", [(359.99, [], 359.99), (360.0, [60], 0.0), (1000.0, [60, 360, 660], 40.0)])
def test_complete_schedule(spark, duration, starts, tail):
    df = spark.createDataFrame([("a", 100.0, int(round(duration * 100)))], "entity_id string, fs double, sample_count long")
    got = sorted(r.start_sec for r in windows.complete_windows(df).collect())
    assert got == starts
    d = F.lit(duration)
    assert spark.range(1).select(windows.tail_seconds(d)).first()[0] == pytest.approx(tail)
    assert spark.range(1).select(windows.window_count(d)).first()[0] == len(starts)


def test_audit_counts(spark):
    d = spark.createDataFrame([(179.999,), (180.0,), (3780.0,), (1e9,), (299.999,), (300.0,), (899.999,), (None,)], "d double")
    got = d.select(windows.hourly_count(F.col("d")), windows.from_zero_count(F.col("d"))).collect()
    assert [r[0] for r in got[:4]] == [0, 1, 2, 24]
    assert [r[1] for r in got[4:7]] == [0, 1, 2]
    assert tuple(got[7]) == (0, 0)


def test_hourly_keeps_windows_outside(spark):
    r = spark.createDataFrame([("a", 1.5, 500)], "entity_id string, fs double, sample_count long")
    rows = windows.hourly_windows(r).orderBy("window_id").collect()
    assert len(rows) == 24 and rows[1].start_sample == int(3660 * 1.5) and rows[0].requested_samples == 180


def test_fractional_rate_assignment(spark):
    # Brute force: every window holds the samples between its rounded bounds.
    fs, n = 2.3, 400
    r = spark.createDataFrame([("a", fs, n)], "entity_id string, fs double, sample_count long")
    s = spark.range(n).select(F.lit("a").alias("entity_id"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("value"))
    sched = {"first": 3, "stride": 7, "length": 7}
    got = sorted((x.window_id, x.pos, x.value) for x in windows.assign_windows(s, r, **sched).collect())
    want = []
    for w in windows.complete_windows(r, **sched).collect():
        want += [(w.window_id, i - w.start_sample, float(i)) for i in range(w.start_sample, w.start_sample + w.requested_samples)]
    assert got == sorted(want)


def test_null_samples_are_read_but_have_no_features(spark):
    r = spark.createDataFrame([("a", 10.0, 400), ("z", 0.0, 400), ("n", None, 400), ("i", float("inf"), 400), ("m", -1.0, 400)], "entity_id string, fs double, sample_count long")
    s = r.select("entity_id", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("sample_idx")).withColumn("value", F.when(F.col("sample_idx") == 150, None).when(F.col("sample_idx") == 250, float("nan")).otherwise(F.sin("sample_idx")))
    sched = {"first": 0, "stride": 10, "length": 10}
    table = signal.window_feature_table(windows.assign_windows(s, r, **sched), windows.complete_windows(r, **sched))
    got = {x.window_id: x for x in table.collect()}
    assert {k: x.window_status for k, x in got.items()} == {0: "SUCCESS", 1: "FEATURE_ERROR", 2: "FEATURE_ERROR", 3: "SUCCESS"}
    assert got[1].read_success and not got[1].extraction_success and got[1].actual_samples == 100 and got[1].sig_mean is None and got[1].failure_reason == "FEATURE_ERROR"
    assert got[0].sig_mean is not None and not got[1].qc_valid
    assert {x.entity_id: x.schedule_status for x in windows.schedule_status(r).collect()} == {"a": "SUCCESS", "z": "INVALID_RATE", "n": "INVALID_RATE", "i": "INVALID_RATE", "m": "INVALID_RATE"}


def test_many_records_meet_samples_by_block(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_SAMPLES", 64)
    r = spark.createDataFrame([("a", 2.3, 1000), ("b", 2.0, 70), ("c", 2.0, 0), ("d", 2.0, None)], "entity_id string, fs double, sample_count long")
    s = r.select("entity_id", F.explode(F.sequence(F.lit(0), F.coalesce("sample_count", F.lit(0)).cast("int"))).alias("sample_idx")).withColumn("value", F.col("sample_idx").cast("double"))
    sched = {"first": 3, "stride": 7, "length": 7}
    for options in ({}, {"rounding": "cut", "count": 6}):
        whole = windows.assign_windows(s, r, **sched, **options)
        cut = windows.assign_windows(s, r, **sched, **options, broadcast_rows=0)
        assert sorted(whole.collect()) == sorted(cut.collect()) and whole.count() > 50
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan


def test_hourly_assignment_cuts_bounds(spark):
    r = spark.createDataFrame([("a", 1.5, 500)], "entity_id string, fs double, sample_count long")
    s = spark.range(500).select(F.lit("a").alias("entity_id"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("value"))
    sched = {"first": 5, "stride": 33, "length": 11, "count": 12}
    got = sorted((x.window_id, x.pos, x.value) for x in windows.assign_windows(s, r, **sched, rounding="cut").collect())
    want = [(w.window_id, i - w.start_sample, float(i)) for w in windows.hourly_windows(r, **sched).collect() for i in range(w.start_sample, min(500, w.end_sample))]
    assert got == sorted(want) and max(w for w, _, _ in got) == 9


def test_status_ladder(spark):
    t = spark.createDataFrame(
        [("a", 0, 0, 4, 4, 100), ("a", 1, 4, 4, 8, 100), ("a", 2, 8, 4, 12, 100), ("a", 3, 98, 4, 102, 100)],
        "entity_id string, window_id long, start_sample long, requested_samples long, end_sample long, sample_count long",
    )
    s = spark.createDataFrame([("a", 0, i, 1.0) for i in range(4)] + [("a", 1, 0, 1.0)], "entity_id string, window_id long, pos long, value double")
    got = {r.window_id: r.window_status for r in windows.window_status(t, s).collect()}
    assert got == {0: "SUCCESS", 1: "SHORT_READ", 2: "EMPTY_SIGNAL", 3: "OUTSIDE_RECORD"}


def _series(spark, values, name="value"):
    rows = [("a", 0, i, float(v), 10.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"entity_id string, window_id long, pos long, {name} double, fs double")


def test_interval_cleaning(spark):
    df = _series(spark, [1.0, 1.05, 3.0, 0.2, 0.95, 1.1], "rr").withColumn("beat_no", F.col("pos") + 1)
    got = [r.valid for r in signal.clean_intervals(df).orderBy("beat_no").collect()]
    assert got == [True, True, False, False, True, True]
    with pytest.raises(ValueError):
        signal.clean_intervals(df, width=4)


def _greedy(values, fs):
    h = np.asarray(values) ** 2
    low = np.percentile(h, 93)
    runs, i = [], 0
    while i < len(h):
        j = i
        while j + 1 < len(h) and h[j + 1] == h[i]:
            j += 1
        if i > 0 and j < len(h) - 1 and h[i - 1] < h[i] > h[j + 1] and h[i] >= low:
            runs.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(runs, key=lambda p: (-h[p], -p)):
        if all(abs(p - k) >= max(int(0.25 * fs), 1) for k in kept):
            kept.append(p)
    return sorted(kept)


def test_peaks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=400), np.round(rng.normal(size=400), 1)):
        df = _series(spark, values).withColumn("fs", F.lit(24.0))
        got = sorted(r.pos for r in signal.detect_peaks(df).collect())
        assert got == _greedy(values, 24.0)


def test_moments_unbiased(spark):
    x = np.random.default_rng(1).normal(size=50)
    r = signal.signal_moments(_series(spark, x)).first()
    n, c = len(x), x - x.mean()
    m2, m3, m4 = (np.mean(c**k) for k in (2, 3, 4))
    assert r.sig_skew == pytest.approx(np.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5)
    assert r.sig_kurt == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6))
    flat = signal.signal_moments(_series(spark, [2.0] * 5)).first()
    assert flat.sig_skew is None and flat.sig_kurt is None


def _entropy_brute(x):
    x, n, r = np.asarray(x), len(x), 0.2 * np.std(x)
    counts, phis = [], []
    for d in (2, 3):
        t = [x[i:i + d] for i in range(n - d)]
        close = np.array([[np.max(np.abs(a - b)) <= r for b in t] for a in t])
        counts.append((close.sum() - len(t)) / 2)
        phis.append(np.mean(np.log(close.sum(axis=1) / len(t) + 1e-8)))
    return -np.log(counts[1] / counts[0]), phis[0] - phis[1]


def test_entropies_match_brute_force(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=60)
    want = _entropy_brute(x)
    r = complexity.entropies(_series(spark, x)).first()
    assert (r.rr_sampen, r.rr_apen) == pytest.approx(want)
    monkeypatch.setattr(complexity, "BLOCK_CELLS", 150)
    assert complexity._entropy_pair(x, 2, 0.2) == pytest.approx(want)
    short = complexity.entropies(_series(spark, x[:9])).first()
    assert short.rr_sampen is None and short.rr_apen is None


def test_dfa_matches_polyfit(spark):
    x = np.random.default_rng(5).normal(size=130)
    y = np.cumsum(x - x.mean())
    f, scales = [], []
    for s in complexity.scale_list(len(x) // 4):
        t = np.arange(s)
        res = [np.mean((y[i * s:(i + 1) * s] - np.polyval(np.polyfit(t, y[i * s:(i + 1) * s], 1), t)) ** 2) for i in range(len(x) // s)]
        f.append(np.sqrt(np.mean(res)))
        scales.append(s)
    want = np.polyfit(np.log(scales), np.log(f), 1)[0]
    assert complexity.dfa_alpha(_series(spark, x)).first().rr_dfa_alpha == pytest.approx(want)
    assert complexity.dfa_alpha(_series(spark, x[:15])).count() == 0


def test_scale_ladder_equals_its_rule(spark):
    rows = spark.range(4, 20_001).select("id", complexity.scale_ladder(F.col("id")).alias("l")).collect()
    assert len(rows) == 19_997
    for r in rows:
        assert r.l == np.unique(np.floor(np.logspace(np.log10(4), np.log10(r.id), num=10)).astype(int)).tolist()


def test_spectrum_shares(spark):
    t = np.arange(200) / 100.0
    df = _series(spark, np.sin(2 * np.pi * 2 * t) + 0.5 * np.sin(2 * np.pi * 20 * t)).withColumn("fs", F.lit(100.0))
    r = spectrum.spectral_bands(df).first()
    assert (r.pow_lf, r.pow_mf, r.pow_hf) == pytest.approx((0.8, 0.0, 0.2), abs=1e-9)
    assert spectrum.spectral_bands(_series(spark, [1.0] * 7)).first().pow_lf is None


def test_qc_and_flag_policy(spark):
    rows = [("a", True, 9, 10, 0.0, ""), ("b", True, 10, 10, 0.3, ""), ("c", True, 10, 10, 0.2, ""), ("d", False, 0, 0, 0.0, "SHORT_READ")]
    df = spark.createDataFrame(rows, "entity_id string, extraction_success boolean, valid_rr_count long, raw_rr_count long, removed_rr_ratio double, failure_reason string")
    got = {r.entity_id: (r.qc_status, r.qc_reason) for r in signal.window_qc(df).collect()}
    assert got == {"a": ("FAIL", "INSUFFICIENT_VALID_NN"), "b": ("FAIL", "INVALID_RR_RATIO"), "c": ("PASS", ""), "d": ("FAIL", "SHORT_READ")}
    assert signal.window_qc(df, F.lit(True)).filter("entity_id = 'c'").first().qc_reason == "AF_INCOMPATIBLE_HRV"
    from cohortflow.functions.constants import WINDOW_FEATURES

    cols = {f: float(i + 1) for i, f in enumerate(WINDOW_FEATURES)}
    one = spark.createDataFrame([(*cols.values(), *[True] * 20, True, True, "PASS", "")],
                                ", ".join([f"{f} double" for f in cols] + [f"{f}_valid boolean" for f in cols]) + ", extraction_success boolean, qc_valid boolean, qc_status string, qc_reason string")
    r = signal.interval_null_policy(one, F.lit(True)).first()
    nulls = [i + 1 for i, f in enumerate(WINDOW_FEATURES) if r[f] is None]
    assert nulls == list(range(8, 17)) and r.sig_mean == 1.0 and r.pow_mf == 18.0 and not r.qc_valid and not r.sdnn_valid and r.sig_mean_valid
    assert signal.interval_null_policy(one, F.lit(False)).first() == one.first()


def test_extraction_takes_no_outcome():
    import inspect

    for fn in (windows.assign_windows, signal.window_feature_table):
        assert not {"label", "outcome", "endpoint"} & set(inspect.signature(fn).parameters)


def test_streaming_equals_batch(spark, sf, tmp_path):
    from cohortflow.streaming.windows import window_aggregates

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = window_aggregates(stream).writeStream.outputMode("append").format("memory").queryName("closed_windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.entity_id, r.start): r.n for r in spark.table("closed_windows").collect()}
    want = {(r.entity_id, r.start): r.n for r in window_aggregates(e).collect()}
    # Append mode holds back only the windows the watermark has not passed.
    assert got and all(want[k] == n for k, n in got.items())
    assert len(want) - len(got) <= e.filter(F.col("ts") > e.agg(F.max("ts")).first()[0] - F.expr("interval 15 minutes")).count()


def test_template_neighbours_match_all_pairs():
    import numpy as np

    from cohortflow.operators.complexity import _template_neighbours

    def slow(x, radius, size):
        t = np.stack([x[k:len(x) - size + k] for k in range(size)])
        return (np.abs(t[:, :, None] - t[:, None, :]) <= radius).all(axis=0).sum(axis=1)

    rng = np.random.default_rng(7)
    for n in (4, 12, 300):
        series = rng.normal(size=n), np.round(rng.normal(size=n), 1) + 800, np.cumsum(rng.normal(size=n)), np.append(rng.normal(size=n), 1e6), np.append(rng.normal(size=n), np.nan)
        for x in series:
            for radius in (0.2 * x.std(), 0.1):
                for size in (1, 2, 3):
                    assert (_template_neighbours(x, radius, size) == slow(x, radius, size)).all()
    assert len(_template_neighbours(np.zeros(2), 0.1, 3)) == 0


def _live(spark, batches, schema, folder, **options):
    """The rows of every batch as one stretch of a stream that stops and goes on from its checkpoint."""
    from cohortflow.streaming.windows import complete_sample_windows

    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        live = complete_sample_windows(spark.readStream.schema(schema).parquet(f"{folder}/in"), first=1, stride=3, length=3, **options)
        run = live.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination()
    return sorted((r.entity_id, r.window_id, r["values"]) for r in spark.read.schema(live.schema).parquet(f"{folder}/out").collect())


LIVE = "entity_id string, sample_idx long, value double, fs double, ts timestamp"


def test_live_windows_leave_when_complete(spark, tmp_path):
    import datetime as dt

    from cohortflow.streaming.windows import complete_sample_windows

    def row(entity, idx, value, fs=1.0, at=None):
        return entity, idx, value, fs, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=idx if at is None else at)

    nan = float("nan")
    batches = [
        [row("a", 0, 9.0), row("a", 1, 1.0), row("a", 3, 3.0), row("a", 3, 2.5), row("b", 1, 1.0), row("b", 2, nan), row("b", 3, None), row(None, 1, 1.0), row("c", 1, 1.0, 0.0)],
        [row("a", 2, 2.0), row("a", 3, 7.0, at=2), row("a", 4, 4.0), row("a", 5, 5.0), row("b", 2, 5.0), row("d", 7, 1.0), row("d", 8, 2.0)],
        [row("a", 1, 8.0), row("b", 4, 1.0), row("b", 5, 1.0), row("d", 9, 3.0)],
    ]
    got = _live(spark, batches, LIVE, str(tmp_path))
    assert got == [("a", 0, [1.0, 2.0, 2.5]), ("b", 0, [1.0, None, None]), ("d", 2, [1.0, 2.0, 3.0])]
    # The batch form sees all rows at once; it differs only where an earlier repeat came in a later stretch.
    flat = spark.createDataFrame([r for b in batches for r in b], LIVE)
    whole = complete_sample_windows(flat, first=1, stride=3, length=3).collect()
    assert sorted((r.entity_id, r.window_id, r["values"]) for r in whole) == [("a", 0, [1.0, 2.0, 7.0]), ("b", 0, [1.0, None, None]), ("d", 2, [1.0, 2.0, 3.0])]


def test_live_windows_drop_late_samples(spark, tmp_path):
    import datetime as dt

    def row(entity, idx):
        return entity, idx, float(idx), 1.0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=idx)

    batches = [[row("a", 1), row("a", 2), row("b", 1000)], [row("b", 1001)], [row("a", 3), row("b", 1002), row("b", 999)]]
    got = _live(spark, batches, LIVE, str(tmp_path), lateness="10 seconds")
    assert got == [("b", 333, [1000.0, 1001.0, 1002.0])]


def test_short_windows_share_states(spark, tmp_path, monkeypatch):
    import datetime as dt

    from cohortflow.streaming import windows as live

    def row(entity, idx):
        return entity, idx, float(idx), 1.0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=idx)

    first = [row(f"e{i}", j) for i in range(40) for j in (1, 2, 4, 5)]
    batches = [first, [row(f"e{i}", 3) for i in range(40)], [row(f"e{i}", 6) for i in range(0, 40, 2)]]
    want = sorted([(f"e{i}", 0, [1.0, 2.0, 3.0]) for i in range(40)] + [(f"e{i}", 1, [4.0, 5.0, 6.0]) for i in range(0, 40, 2)])
    for short, name, states in ((10_000, "shared", 3), (0, "own", 80)):
        monkeypatch.setattr(live, "SHORT", short)
        monkeypatch.setattr(live, "STATES", 3)
        assert _live(spark, batches, LIVE, str(tmp_path / name)) == want
        assert spark.read.format("statestore").load(str(tmp_path / name / "progress")).count() == states


def test_short_series_are_compared_without_strips(monkeypatch):
    rng = np.random.default_rng(5)
    series = [rng.normal(size=64), np.round(rng.normal(size=40), 1), np.append(rng.normal(size=20), [np.nan, 1.0]), np.ones(30)]
    with monkeypatch.context() as m:
        m.setattr(complexity, "FEW_TEMPLATES", 0)
        strips = [complexity._template_neighbours(x, 0.3, size) for x in series for size in (1, 2, 3)]
    with monkeypatch.context() as m:
        m.setattr(complexity.np, "lexsort", None)  # sorts the strips
        plain = [complexity._template_neighbours(x, 0.3, size) for x in series for size in (1, 2, 3)]
    assert all((a == b).all() for a, b in zip(strips, plain, strict=True))
