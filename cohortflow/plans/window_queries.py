"""Queries over window schedules and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import WINDOW_FEATURES
from ..operators import complexity, signal, spectrum, windows
from . import tables as t
from .registry import query

K = ["entity_id", "window_id"]


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# A record per order whose duration in seconds is its price.
DUR = "SELECT o_orderkey AS entity_id, o_totalprice / 50 AS d FROM orders"


def _durations(spark, sf):
    return t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"), (F.col("o_totalprice") / 50).alias("d"))


N_SQL = "CASE WHEN d + 1e-9 >= 360 THEN CAST(floor((d - 360) / 300.0 + 1e-9) + 1 AS BIGINT) ELSE 0 END"


@query("complete_window_starts", f"SELECT entity_id, w AS window_id, 60 + 300 * w AS start_sec FROM (SELECT entity_id, unnest(range({N_SQL})) AS w FROM ({DUR}))")
def _(spark, sf):
    r = _durations(spark, sf).select("entity_id", F.lit(1.0).alias("fs"), F.col("d").alias("sample_count"))
    return windows.complete_windows(r).select("entity_id", "window_id", "start_sec")


@query(
    "fixed_window_starts",
    f"""SELECT entity_id, w AS window_id, 60 + 3600 * w AS start_sec, CASE WHEN 60 + 3600 * w + 120 > d THEN 'OUTSIDE_RECORD' ELSE 'INSIDE' END AS place FROM (SELECT o_orderkey AS entity_id, floor(o_totalprice / 5) AS d,
      unnest(range(24)) AS w FROM orders)""",
)
def _(spark, sf):
    r = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"), F.lit(1.0).alias("fs"), F.floor(F.col("o_totalprice") / 5).alias("sample_count"))
    w = windows.hourly_windows(r)
    place = F.when(F.col("end_sample") > F.col("sample_count"), "OUTSIDE_RECORD").otherwise("INSIDE")
    return w.select("entity_id", "window_id", "start_sec", place.alias("place"))


@query(
    "window_counts_from_duration",
    f"""WITH d AS ({DUR}) SELECT entity_id, CASE WHEN d + 1e-9 >= 180 THEN least(floor((d + 1e-9 - 180) / 3600.0) + 1, 24)::BIGINT ELSE 0 END AS hourly,
      CASE WHEN d >= 300 THEN floor((d + 1e-9) / 300)::BIGINT ELSE 0 END AS from_zero FROM d""",
)
def _(spark, sf):
    return _durations(spark, sf).select("entity_id", windows.hourly_count(F.col("d")).alias("hourly"), windows.from_zero_count(F.col("d")).alias("from_zero"))


@query("tail_seconds", f"SELECT entity_id, round(greatest(CASE WHEN n > 0 THEN d - (360 + (n - 1) * 300) ELSE d END, 0), 4) AS tail FROM (SELECT *, {N_SQL} AS n FROM ({DUR}))")
def _(spark, sf):
    return _durations(spark, sf).select("entity_id", F.round(windows.tail_seconds(F.col("d")), 4).alias("tail"))


@query("window_assign", f"WITH {t.SAMPLES_SQL} SELECT entity_id, window_id, pos, round(value, 6) AS value FROM inwin")
def _(spark, sf):
    w = windows.assign_windows(t.samples(spark, sf), t.records(spark, sf), **t.SHORT_SCHEDULE)
    return w.select(*K, "pos", F.round("value", 6).alias("value"))


@query(
    "window_status",
    f"""WITH {t.SAMPLES_SQL}, fixed AS (SELECT entity_id, sample_count, unnest(range(5)) AS window_id FROM records),
    kept AS (SELECT entity_id, window_id, CASE WHEN NOT (entity_id % 3 = 0 AND window_id = 0 AND pos = 5) THEN value END AS value FROM inwin WHERE NOT (window_id = 1 AND value > 0) AND window_id <> 2),
    c AS (SELECT entity_id, window_id, count(*) AS n, count(value) AS f FROM kept GROUP BY 1, 2)
    SELECT entity_id, window_id, CASE WHEN (24 + window_id * 20) * {int(t.RATE)} > sample_count THEN 0 ELSE coalesce(n, 0) END AS actual_samples,
      CASE WHEN (24 + window_id * 20) * {int(t.RATE)} > sample_count THEN 'OUTSIDE_RECORD' WHEN entity_id % 4 = 1 AND window_id = 0 THEN 'READ_ERROR' WHEN n IS NULL THEN 'EMPTY_SIGNAL' WHEN n <> 320 THEN 'SHORT_READ'
      WHEN f <> n THEN 'FEATURE_ERROR' ELSE 'SUCCESS' END AS window_status
    FROM fixed LEFT JOIN c USING (entity_id, window_id)""",
)
def _(spark, sf):
    r = t.records(spark, sf)
    w = windows.assign_windows(t.samples(spark, sf), r, **t.SHORT_SCHEDULE)
    lost = (F.col("entity_id") % 3 == 0) & (F.col("window_id") == 0) & (F.col("pos") == 5)
    kept = w.filter("not (window_id = 1 and value > 0) and window_id <> 2").withColumn("value", F.when(~lost, F.col("value")))
    fixed = windows.hourly_windows(r, **t.SHORT_SCHEDULE, count=5).withColumn("read_ok", ~((F.col("entity_id") % 4 == 1) & (F.col("window_id") == 0)))
    return windows.window_status(fixed, kept).select(*K, "actual_samples", "window_status")


SCALED_SQL = t.VECTORS_SQL + """,
stat AS (SELECT entity_id, window_id, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM vec GROUP BY 1, 2),
scaled AS (SELECT entity_id, window_id, pos, (value - med) / CASE WHEN sd > 1e-8 THEN sd ELSE 1 END AS value, fs FROM vec JOIN stat USING (entity_id, window_id))"""


@query("median_center_scale", f"WITH {SCALED_SQL} SELECT entity_id, window_id, pos, round(value, 6) AS value FROM scaled")
def _(spark, sf):
    return signal.center_scale(t.vector_windows(spark, sf)).select(*K, "pos", F.round("value", 6).alias("value"))


@query(
    "signal_moments",
    f"""WITH {SCALED_SQL}, m AS (SELECT entity_id, window_id, count(*)::DOUBLE AS n, avg(value) AS sig_mean, stddev_pop(value) AS sig_std, max(value) - min(value) AS sig_p2p, skewness(value) AS sk, kurtosis_pop(value) AS ku
      FROM scaled GROUP BY 1, 2) SELECT entity_id, window_id, round(sig_mean, 6) AS sig_mean, round(sig_std, 6) AS sig_std, round(sig_p2p, 6) AS sig_p2p, round(sk, 6) AS sig_skew,
      round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ku + 6), 6) AS sig_kurt FROM m""",
)
def _(spark, sf):
    df = signal.signal_moments(signal.center_scale(t.vector_windows(spark, sf))).drop("n_samples", "n_finite", "fs")
    return _rounded(df, ["sig_mean", "sig_std", "sig_p2p", "sig_skew", "sig_kurt"])


def _peak_sql(source: str) -> str:
    # Candidates, then a walk from the highest candidate down that keeps what no kept one is close to.
    return f"""
sq AS (SELECT entity_id, window_id, pos, fs, value * value AS h FROM {source}),
lim AS (SELECT entity_id, window_id, quantile_cont(h, 0.93) AS lo FROM sq GROUP BY 1, 2),
nb AS (SELECT *, lag(h) OVER w AS p, lead(h) OVER w AS nx FROM sq WINDOW w AS (PARTITION BY entity_id, window_id ORDER BY pos)),
cand AS (SELECT entity_id, window_id, pos, h, fs FROM nb JOIN lim USING (entity_id, window_id) WHERE p < h AND nx < h AND h >= lo),
lists AS (SELECT entity_id, window_id, list(pos ORDER BY h DESC, pos DESC) AS c, greatest(floor(0.25 * max(fs)), 1) AS gap FROM cand GROUP BY 1, 2),
kept AS (SELECT entity_id, window_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x) < gap)) > 0 THEN acc ELSE list_append(acc, x) END, []::BIGINT[])) AS pos FROM lists),
peaks AS (SELECT entity_id, window_id, pos, {t.RATE}::DOUBLE AS fs FROM kept),
gaps AS (SELECT *, (pos - lag(pos) OVER (PARTITION BY entity_id, window_id ORDER BY pos)) / fs AS rr FROM peaks),
rrs AS (SELECT entity_id, window_id, rr, row_number() OVER (PARTITION BY entity_id, window_id ORDER BY pos) AS beat_no FROM gaps WHERE rr IS NOT NULL),
loc AS (SELECT *, median(rr) OVER (PARTITION BY entity_id, window_id ORDER BY beat_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM rrs),
checked AS (SELECT entity_id, window_id, beat_no, rr, m, rr BETWEEN 0.3 AND 2.0 AND m > 0 AND abs(rr - m) / m <= 0.2 + 1e-12 AS valid FROM loc)"""


LONG_SQL = t.SAMPLES_SQL + """,
stat AS (SELECT entity_id, window_id, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd, count(*) AS n FROM inwin GROUP BY 1, 2),
scaled AS (SELECT entity_id, window_id, pos, (value - med) / CASE WHEN sd > 1e-8 THEN sd ELSE 1 END AS value, fs FROM inwin JOIN stat USING (entity_id, window_id)),""" + _peak_sql("scaled")


def _scaled(spark, sf):
    return signal.center_scale(windows.assign_windows(t.samples(spark, sf), t.records(spark, sf), **t.SHORT_SCHEDULE))


def _intervals(spark, sf):
    return signal.interval_series(signal.detect_peaks(_scaled(spark, sf)))


@query("peak_detect", f"WITH {LONG_SQL} SELECT entity_id, window_id, pos FROM peaks")
def _(spark, sf):
    return signal.detect_peaks(_scaled(spark, sf)).select(*K, "pos")


@query(
    "beat_rate",
    f"""WITH {LONG_SQL}, c AS (SELECT entity_id, window_id, count(*) AS b FROM peaks GROUP BY 1, 2)
    SELECT entity_id, window_id, coalesce(b, 0)::DOUBLE AS beats, round(coalesce(b, 0) * 60.0 / (n / {t.RATE} + 1e-8), 6) AS beats_per_min FROM stat LEFT JOIN c USING (entity_id, window_id)""",
)
def _(spark, sf):
    s = _scaled(spark, sf)
    sizes = s.groupBy(*K).agg(F.count("value").alias("n_samples"), F.first("fs").alias("fs"))
    return _rounded(signal.beat_rate(sizes, signal.detect_peaks(s)), ["beats_per_min"])


@query("interval_series", f"WITH {LONG_SQL} SELECT entity_id, window_id, beat_no, rr FROM rrs")
def _(spark, sf):
    return _intervals(spark, sf).withColumn("beat_no", F.col("beat_no").cast("long"))


@query("rolling_median_clean", f"WITH {LONG_SQL} SELECT entity_id, window_id, beat_no, rr, round(m, 6) AS local_median, valid FROM checked")
def _(spark, sf):
    df = signal.clean_intervals(_intervals(spark, sf)).withColumn("beat_no", F.col("beat_no").cast("long"))
    return _rounded(df, ["local_median"])


TIME_SQL = """td AS (SELECT *, rr - lag(rr) OVER (PARTITION BY entity_id, window_id ORDER BY beat_no) AS d FROM checked WHERE valid),
tdom AS (SELECT entity_id, window_id, CASE WHEN count(*) >= 3 THEN avg(rr) END AS mean_rr, CASE WHEN count(*) >= 3 THEN stddev_samp(rr) END AS sdnn,
    CASE WHEN count(*) >= 3 THEN sqrt(avg(d * d)) END AS rmssd, CASE WHEN count(*) >= 3 THEN avg((abs(d) > 0.05)::INT) * 100 END AS pnn50,
    CASE WHEN count(*) >= 3 THEN 60 / avg(rr) END AS mean_hr, CASE WHEN count(*) >= 3 THEN stddev_pop(rr) / (avg(rr) + 1e-8) END AS rr_cv FROM td GROUP BY 1, 2)"""
TD = ["mean_rr", "sdnn", "rmssd", "pnn50", "mean_hr", "rr_cv"]


@query("interval_time_domain", f"WITH {LONG_SQL}, {TIME_SQL} SELECT entity_id, window_id, {', '.join(f'round({c}, 6) AS {c}' for c in TD)} FROM tdom")
def _(spark, sf):
    return _rounded(signal.interval_time_domain(signal.clean_intervals(_intervals(spark, sf)).filter("valid")), TD)


RADIUS_SQL = t.VECTORS_SQL + """,
r AS (SELECT entity_id, window_id, 0.2 * stddev_pop(value) AS r, count(*) AS n FROM vec GROUP BY 1, 2),
tpl AS (SELECT entity_id, window_id, pos, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c, r, n FROM vec JOIN r USING (entity_id, window_id) WINDOW w AS (PARTITION BY entity_id, window_id ORDER BY pos)),
pr AS (SELECT x.entity_id, x.window_id, x.pos AS i, y.pos AS j, x.n, abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r AND x.pos < x.n - 2 AND y.pos < x.n - 2 AS m2,
    abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r AND abs(x.c - y.c) <= x.r AND x.pos < x.n - 3 AND y.pos < x.n - 3 AS m3
  FROM tpl x JOIN tpl y USING (entity_id, window_id))"""


@query(
    "sample_entropy",
    f"""WITH {RADIUS_SQL} SELECT entity_id, window_id, round(CASE WHEN count(*) FILTER (i < j AND m2) > 0 AND count(*) FILTER (i < j AND m3) > 0
      THEN -ln(count(*) FILTER (i < j AND m3)::DOUBLE / count(*) FILTER (i < j AND m2)) END, 6) AS rr_sampen FROM pr GROUP BY 1, 2""",
)
def _(spark, sf):
    return complexity.entropies(t.vector_windows(spark, sf)).select(*K, F.round("rr_sampen", 6).alias("rr_sampen"))


@query(
    "approximate_entropy",
    f"""WITH {RADIUS_SQL}, ci AS (SELECT entity_id, window_id, i, max(n) AS n, count(*) FILTER (m2) AS c2, count(*) FILTER (m3) AS c3 FROM pr GROUP BY 1, 2, 3)
    SELECT entity_id, window_id, round(avg(ln(c2::DOUBLE / (n - 2) + 1e-8)) FILTER (i < n - 2) - avg(ln(c3::DOUBLE / (n - 3) + 1e-8)) FILTER (i < n - 3), 6) AS rr_apen FROM ci GROUP BY 1, 2""",
)
def _(spark, sf):
    return complexity.entropies(t.vector_windows(spark, sf)).select(*K, F.round("rr_apen", 6).alias("rr_apen"))


LADDER_SQL = """lad AS (SELECT entity_id, window_id, unnest(list_distinct(list_transform(range(10), lambda i: floor(pow(10.0::DOUBLE, CASE WHEN i = 9 THEN log10((n // 4)::DOUBLE)
      ELSE i * ((log10((n // 4)::DOUBLE) - log10(4.0::DOUBLE)) / 9.0::DOUBLE) + log10(4.0::DOUBLE) END))::BIGINT))) AS s FROM mu WHERE n >= 16)"""
DFA_SQL = """seg AS (SELECT *, pos // s AS g, (pos % s)::DOUBLE AS tt FROM sc WHERE pos // s < n // s AND n // s >= 2),
    res AS (SELECT entity_id, window_id, s, g, greatest(var_pop(y) - covar_pop(tt, y) ** 2 / var_pop(tt), 0) AS r FROM seg GROUP BY ALL),
    fl AS (SELECT entity_id, window_id, s, sqrt(avg(r)) AS f FROM res GROUP BY ALL)"""


@query(
    "dfa_alpha",
    f"""WITH {t.VECTORS_SQL}, mu AS (SELECT entity_id, window_id, avg(value) AS m, count(*) AS n FROM vec GROUP BY 1, 2),
    prof AS (SELECT entity_id, window_id, pos, n, sum(value - m) OVER (PARTITION BY entity_id, window_id ORDER BY pos) AS y FROM vec JOIN mu USING (entity_id, window_id)),
    {LADDER_SQL},
    sc AS (SELECT prof.*, s FROM prof JOIN lad USING (entity_id, window_id)), {DFA_SQL}
    SELECT entity_id, window_id, round(regr_slope(ln(f), ln(s)), 5) AS rr_dfa_alpha FROM fl WHERE f > 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    return complexity.dfa_alpha(t.vector_windows(spark, sf)).select(*K, F.round("rr_dfa_alpha", 5).alias("rr_dfa_alpha"))


def _power_sql(source: str, n: int) -> str:
    return f"""
pw AS (SELECT entity_id, window_id, k, (pow(sum(value * cos(2 * pi() * k * pos / {n})), 2) + pow(sum(value * sin(2 * pi() * k * pos / {n})), 2)) / {n} AS p
  FROM {source}, (SELECT unnest(range({n // 2 + 1})) AS k) GROUP BY 1, 2, 3),
bands AS (SELECT entity_id, window_id, sum(p) + 1e-12 AS tot, sum(p) FILTER (k * {t.RATE} / {n} >= 0.5 AND k * {t.RATE} / {n} < 4) AS lf, coalesce(sum(p) FILTER (k * {t.RATE} / {n} >= 4 AND k * {t.RATE} / {n} < 15), 0) AS mf,
    coalesce(sum(p) FILTER (k * {t.RATE} / {n} >= 15 AND k * {t.RATE} / {n} < 40), 0) AS hf FROM pw GROUP BY 1, 2)"""


@query(
    "spectral_bands",
    f"""WITH {SCALED_SQL}, {_power_sql('scaled', t.VECTOR)} SELECT entity_id, window_id, round(lf / tot, 6) AS pow_lf, round(mf / tot, 6) AS pow_mf, round(hf / tot, 6) AS pow_hf,
      round((hf / tot) / (lf / tot + mf / tot + 1e-12), 6) AS pow_hf_ratio FROM bands""",
)
def _(spark, sf):
    df = spectrum.spectral_bands(signal.center_scale(t.vector_windows(spark, sf)))
    return _rounded(df, ["pow_lf", "pow_mf", "pow_hf", "pow_hf_ratio"])


def _table(spark, sf):
    r = t.records(spark, sf)
    w = windows.assign_windows(t.samples(spark, sf), r, **t.SHORT_SCHEDULE)
    return signal.window_feature_table(w, windows.complete_windows(r, **t.SHORT_SCHEDULE))


def _feature_sql(clean: bool, theory: str) -> str:
    """Every column of the window feature table; `theory` (entity_id, window_id, status) states the windows and what became of them."""
    long = LONG_SQL if clean else LONG_SQL.replace("rr BETWEEN 0.3 AND 2.0 AND m > 0 AND abs(rr - m) / m <= 0.2 + 1e-12 AS valid", "TRUE AS valid")
    ok = {f: f"CASE WHEN status = 'SUCCESS' THEN {f} END" for f in ("sig_mean", "sig_std", "sig_p2p", "sig_skew", "sig_kurt", "beats", "beats_per_min")}
    features = {f: ok.get(f, f) for f in WINDOW_FEATURES}
    return f"""WITH {long}, {TIME_SQL}, {_power_sql('scaled', 320)}, {theory},
    mo AS (SELECT entity_id, window_id, avg(value) AS sig_mean, stddev_pop(value) AS sig_std, max(value) - min(value) AS sig_p2p, skewness(value) AS sig_skew,
      (count(*) - 1)::DOUBLE / ((count(*) - 2) * (count(*) - 3)) * ((count(*) + 1) * kurtosis_pop(value) + 6) AS sig_kurt FROM scaled GROUP BY 1, 2),
    pk AS (SELECT entity_id, window_id, count(*) AS b FROM peaks GROUP BY 1, 2),
    ct AS (SELECT entity_id, window_id, count(*) AS raw, count(*) FILTER (valid) AS good FROM checked GROUP BY 1, 2),
    ser AS (SELECT entity_id, window_id, rr AS value, row_number() OVER (PARTITION BY entity_id, window_id ORDER BY beat_no) - 1 AS pos, count(*) OVER (PARTITION BY entity_id, window_id) AS n FROM checked WHERE valid),
    vec2 AS (SELECT *, 0.2 * stddev_pop(value) OVER (PARTITION BY entity_id, window_id) AS r FROM ser WHERE n >= 10),
    tpl AS (SELECT *, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c FROM vec2 WINDOW w AS (PARTITION BY entity_id, window_id ORDER BY pos)),
    pr AS (SELECT x.entity_id, x.window_id, x.pos AS i, y.pos AS j, x.n, abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r AND x.pos < x.n - 2 AND y.pos < x.n - 2 AS m2,
      abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r AND abs(x.c - y.c) <= x.r AND x.pos < x.n - 3 AND y.pos < x.n - 3 AS m3 FROM tpl x JOIN tpl y USING (entity_id, window_id)),
    sampen AS (SELECT entity_id, window_id, CASE WHEN count(*) FILTER (i < j AND m2) > 0 AND count(*) FILTER (i < j AND m3) > 0
      THEN -ln(count(*) FILTER (i < j AND m3)::DOUBLE / count(*) FILTER (i < j AND m2)) END AS rr_sampen FROM pr GROUP BY 1, 2),
    ci AS (SELECT entity_id, window_id, i, max(n) AS n, count(*) FILTER (m2) AS c2, count(*) FILTER (m3) AS c3 FROM pr GROUP BY 1, 2, 3),
    apen AS (SELECT entity_id, window_id, avg(ln(c2::DOUBLE / (n - 2) + 1e-8)) FILTER (i < n - 2) - avg(ln(c3::DOUBLE / (n - 3) + 1e-8)) FILTER (i < n - 3) AS rr_apen FROM ci GROUP BY 1, 2),
    mu AS (SELECT entity_id, window_id, avg(value) AS m, max(n) AS n FROM ser WHERE n >= 16 GROUP BY 1, 2),
    prof AS (SELECT entity_id, window_id, pos, mu.n, sum(value - m) OVER (PARTITION BY entity_id, window_id ORDER BY pos) AS y FROM ser JOIN mu USING (entity_id, window_id)),
    {LADDER_SQL},
    sc AS (SELECT prof.*, s FROM prof JOIN lad USING (entity_id, window_id)), {DFA_SQL},
    alpha AS (SELECT entity_id, window_id, CASE WHEN count(*) >= 2 THEN regr_slope(ln(f), ln(s)) END AS rr_dfa_alpha FROM fl WHERE f > 0 GROUP BY 1, 2),
    wide AS (SELECT entity_id, window_id, status, coalesce(b, 0) AS raw_rpeak_count, coalesce(raw, 0) AS raw_rr_count, coalesce(good, 0) AS valid_rr_count, coalesce(raw - good, 0) AS removed_rr_count,
      coalesce((raw - good)::DOUBLE / nullif(raw, 0), 0) AS removed_rr_ratio, sig_mean, sig_std, sig_p2p, sig_skew, sig_kurt, coalesce(b, 0)::DOUBLE AS beats, coalesce(b, 0) * 60.0 / (320 / {t.RATE} + 1e-8) AS beats_per_min,
      {', '.join(TD)}, rr_sampen, rr_apen, rr_dfa_alpha, lf / tot AS pow_lf, mf / tot AS pow_mf, hf / tot AS pow_hf, (hf / tot) / (lf / tot + mf / tot + 1e-12) AS pow_hf_ratio
      FROM th {' '.join(f'LEFT JOIN {x} USING (entity_id, window_id)' for x in ('mo', 'pk', 'ct', 'tdom', 'sampen', 'apen', 'alpha', 'bands'))}),
    q AS (SELECT *, CASE WHEN status <> 'SUCCESS' THEN status ELSE concat_ws(';', CASE WHEN valid_rr_count < 10 THEN 'INSUFFICIENT_VALID_NN' END, CASE WHEN removed_rr_ratio > 0.2 THEN 'INVALID_RR_RATIO' END) END AS qc_reason FROM wide)
    SELECT entity_id, window_id, status AS window_status, raw_rpeak_count, raw_rr_count, valid_rr_count, removed_rr_count, round(removed_rr_ratio, 6) AS removed_rr_ratio,
      {', '.join(f'round({e}, 5) AS {f}, {e} IS NOT NULL AS {f}_valid' for f, e in features.items())}, qc_reason, qc_reason = '' AS qc_valid FROM q"""


FEATURE_COLUMNS = ["window_status", "raw_rpeak_count", "raw_rr_count", "valid_rr_count", "removed_rr_count", "removed_rr_ratio", *WINDOW_FEATURES, *[f"{f}_valid" for f in WINDOW_FEATURES], "qc_reason", "qc_valid"]


def _feature_rows(table):
    return _rounded(_rounded(table.select(*K, *FEATURE_COLUMNS), ["removed_rr_ratio"]), WINDOW_FEATURES, 5)


@query("window_feature_row", _feature_sql(True, "th AS (SELECT entity_id, window_id, 'SUCCESS' AS status FROM theory)"))
def _(spark, sf):
    return _feature_rows(_table(spark, sf))


@query(
    "legacy_window_feature_row",
    _feature_sql(False, f"""th AS (SELECT entity_id, window_id, CASE WHEN (24 + window_id * 20) * {int(t.RATE)} > sample_count THEN 'OUTSIDE_RECORD' ELSE 'SUCCESS' END AS status
      FROM (SELECT entity_id, sample_count, unnest(range(6)) AS window_id FROM records))"""),
)
def _(spark, sf):
    # The fixed schedule end to end: cut bounds, a fixed number of starts, every interval kept.
    r = t.records(spark, sf)
    w = windows.assign_windows(t.samples(spark, sf), r, **t.SHORT_SCHEDULE, rounding="cut", count=6)
    inside = windows.hourly_windows(r, **t.SHORT_SCHEDULE, count=6)
    return _feature_rows(signal.window_feature_table(w, inside, clean=False))


@query(
    "window_qc",
    f"""WITH {LONG_SQL}, ct AS (SELECT entity_id, window_id, count(*) AS raw, count(*) FILTER (valid) AS good FROM checked GROUP BY 1, 2),
    q AS (SELECT entity_id, window_id, concat_ws(';', CASE WHEN entity_id % 4 = 0 THEN 'AF_INCOMPATIBLE_HRV' END, CASE WHEN coalesce(good, 0) < 10 THEN 'INSUFFICIENT_VALID_NN' END,
      CASE WHEN coalesce((raw - good) / raw, 0) > 0.2 THEN 'INVALID_RR_RATIO' END) AS reason FROM theory LEFT JOIN ct USING (entity_id, window_id))
    SELECT entity_id, window_id, reason = '' AS qc_valid, CASE WHEN reason = '' THEN 'PASS' ELSE 'FAIL' END AS qc_status, reason AS qc_reason FROM q""",
)
def _(spark, sf):
    r = t.records(spark, sf)
    counts = signal.interval_counts(signal.clean_intervals(_intervals(spark, sf)))
    w = windows.complete_windows(r, **t.SHORT_SCHEDULE).select(*K).join(counts, K, "left").withColumns(
        {"extraction_success": F.lit(True), "failure_reason": F.lit("")}
    )
    return signal.window_qc(w, F.col("entity_id") % 4 == 0).select(*K, "qc_valid", "qc_status", "qc_reason")


@query("split_manifest_features", f"WITH {t.SAMPLES_SQL} SELECT count(*) AS windows, count(*) AS features, 0::BIGINT AS unmatched FROM theory")
def _(spark, sf):
    manifest, values = signal.split_manifest_features(_table(spark, sf))
    a, b = manifest.select(*K, F.lit(1).alias("m")), values.select(*K, F.lit(1).alias("v"))
    return a.join(b, K, "full").agg(
        F.count("m").alias("windows"), F.count("v").alias("features"), F.count_if(F.col("m").isNull() | F.col("v").isNull()).alias("unmatched")
    )


@query(
    "streaming_window_aggregates",
    """SELECT user_id AS entity_id, CAST(epoch(ts) - 60 AS BIGINT) // 300 AS slot, count(*) AS n, round(avg(value), 6) AS sig_mean, round(stddev_pop(value), 6) AS sig_std, round(max(value) - min(value), 6) AS sig_p2p
      FROM (SELECT user_id, date_trunc('second', ts) AS ts, value FROM events) GROUP BY 1, 2""",
)
def _(spark, sf):
    from ..streaming.windows import window_aggregates

    e = t.read(spark, sf, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    w = window_aggregates(e)
    slot = F.floor((F.unix_timestamp("start") - 60) / 300)
    return w.select("entity_id", slot.alias("slot"), "n", *[F.round(c, 6).alias(c) for c in ("sig_mean", "sig_std", "sig_p2p")])


#: Seconds of one sample of the stand-in stream, and its windows of three samples, the first one sample in.
SLOT = 43200
STREAM_SCHEDULE = {"first": 1, "stride": 3, "length": 3}


@query(
    "streaming_complete_windows",
    f"""WITH s AS (SELECT user_id AS entity_id, CAST(floor(epoch(ts)) AS BIGINT) // {SLOT} AS idx, ts, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    one AS (SELECT entity_id, idx, value FROM s QUALIFY row_number() OVER (PARTITION BY entity_id, idx ORDER BY ts, value NULLS FIRST) = 1)
    SELECT entity_id, (idx - 1) // 3 AS window_id, round(max(value) FILTER ((idx - 1) % 3 = 0), 6) AS first_value, round(max(value) FILTER ((idx - 1) % 3 = 2), 6) AS last_value, round(sum(value), 6) AS total
    FROM one GROUP BY 1, 2 HAVING count(*) = 3""",
)
def _(spark, sf):
    """The events arrive in four stretches of time; the stream stops after each and goes on from its checkpoint."""
    from ..session import scratch_path
    from ..streaming.windows import complete_sample_windows

    e = t.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.select(F.col("user_id").alias("entity_id"), F.floor(F.unix_timestamp("ts") / SLOT).alias("sample_idx"), "value", F.lit(1.0).alias("fs"), "ts")
    low, high = s.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    arrived, out, progress = (scratch_path(spark, name) for name in ("arrived", "windows", "progress"))
    part = F.least(F.floor((F.unix_micros("ts") - F.lit(low or 0)) * 4 / F.lit((high or 0) - (low or 0) + 1)), F.lit(3))
    for k in range(4):
        s.filter(part == k).write.mode("append").parquet(arrived)
        live = complete_sample_windows(spark.readStream.schema(s.schema).parquet(arrived), **STREAM_SCHEDULE, span=SLOT * 3)
        run = live.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).start(out)
        run.awaitTermination()
    w = spark.read.schema(live.schema).parquet(out)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return w.select("entity_id", "window_id", F.round(F.get("values", F.lit(0)), 6).alias("first_value"), F.round(F.get("values", F.lit(2)), 6).alias("last_value"), F.round(total, 6).alias("total"))
