"""Queries over entity aggregation, distributions, sorting and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import HORIZONS, STATES
from ..functions.parsing import normalise_code
from ..operators import aggregate, distributions, features, population
from ..operators.endpoints import build_endpoint
from ..operators.metrics import run_metrics, score_curve
from ..operators.ordered import value_splits
from . import tables as t
from .parsing_queries import STATS_SQL
from .registry import query

KEY = ["entity_id"]
STATS = ("mean", "std", "p10", "p50", "p90")


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


STAT_COLS = [f"{f}_{s}" for f in t.FEATURES for s in STATS]
STAT_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in STAT_COLS)
COUNT_COLS = ", ".join(f"{f}_valid_count" for f in t.FEATURES)


def _usable(spark, sf):
    w = t.windows(spark, sf)
    return aggregate.usable_values(w, KEY, t.FEATURES, aggregate.success_mask(w))


@query("five_stat_aggregate", f"WITH {STATS_SQL} SELECT entity_id, {STAT_ROUND}, {COUNT_COLS} FROM stats")
def _(spark, sf):
    return _rounded(aggregate.five_stats(_usable(spark, sf), KEY, t.FEATURES), STAT_COLS)


NULL_KEY_STATS_SQL = STATS_SQL.replace("FROM usable GROUP BY entity_id", "FROM (SELECT * REPLACE (nullif(entity_id, 1) AS entity_id) FROM usable) GROUP BY entity_id")


@query("five_stat_aggregate_split_groups", f"WITH {NULL_KEY_STATS_SQL} SELECT entity_id, {STAT_ROUND}, {COUNT_COLS} FROM stats")
def _(spark, sf):
    # The way large groups take, here for every group of more than one row; one entity has no key.
    values = _usable(spark, sf).withColumn("entity_id", F.nullif("entity_id", F.lit(1)))
    return _rounded(aggregate.five_stats(values, KEY, t.FEATURES, hot_rows=5), STAT_COLS)


COUNTS_SQL = t.SUBJECTS_SQL + "," + STATS_SQL + """, counts AS (SELECT entity_id, count(*) AS n, count(*) FILTER (extraction_success) AS ok, count(*) FILTER (qc_valid) AS qc,
    CAST(sum(raw_rpeak_count) FILTER (extraction_success) AS DOUBLE) AS peaks, CAST(sum(raw_rr_count) FILTER (extraction_success) AS DOUBLE) AS raw,
    CAST(sum(valid_rr_count) FILTER (extraction_success) AS DOUBLE) AS good, CAST(sum(removed_rr_count) FILTER (extraction_success) AS DOUBLE) AS gone FROM windows GROUP BY 1),
burden AS (SELECT s.entity_id, s.pvc_count_24h, CASE WHEN s.pvc_count_24h IS NOT NULL THEN CASE WHEN c.n IS NOT NULL THEN coalesce(c.peaks, 0) END END AS beats,
    CASE WHEN s.pvc_count_24h IS NOT NULL AND coalesce(c.peaks, 0) > 0 THEN s.pvc_count_24h / c.peaks END AS ratio,
    CASE WHEN s.pvc_count_24h IS NULL THEN 'UNAVAILABLE_OFFICIAL_COUNT' WHEN c.n IS NULL THEN 'UNAVAILABLE_NO_COVERAGE'
      WHEN coalesce(c.peaks, 0) <= 0 THEN 'UNAVAILABLE_NO_DETECTED_BEATS' ELSE 'AVAILABLE' END AS status FROM subjects s LEFT JOIN counts c USING (entity_id))"""


@query(
    "entity_feature_table",
    f"""WITH {COUNTS_SQL}, spine AS (SELECT entity_id FROM subjects UNION SELECT entity_id FROM windows)
    SELECT entity_id, {STAT_ROUND}, {", ".join(f"coalesce({f}_valid_count, 0) AS {f}_valid_count" for f in t.FEATURES)}, coalesce(n, 0) AS n_windows_theoretical,
      coalesce(ok, 0) AS n_windows_successful, coalesce(qc, 0) AS n_windows_qc_valid, coalesce(ok, 0) AS n_windows_used, round(coalesce(ok / n, 0), 6) AS window_success_rate,
      coalesce(peaks, 0) AS raw_rpeak_count_total, coalesce(raw, 0) AS raw_rr_count_total, coalesce(good, 0) AS valid_rr_count_total, coalesce(gone, 0) AS removed_rr_count_total,
      followup_days, b.pvc_count_24h, b.beats AS pvc_denominator_beats, round(b.ratio, 6) AS pvc_burden, coalesce(b.ratio > 0.2, FALSE) AS high_pvc_burden, b.status AS pvc_burden_status
    FROM spine LEFT JOIN counts USING (entity_id) LEFT JOIN stats USING (entity_id) LEFT JOIN subjects USING (entity_id) LEFT JOIN burden b USING (entity_id)""",
)
def _(spark, sf):
    df = aggregate.entity_feature_table(t.windows(spark, sf), t.FEATURES, subjects=t.subjects(spark, sf), metadata=["followup_days"])
    return _rounded(df, [*STAT_COLS, "window_success_rate", "pvc_burden"])


@query(
    "legacy_entity_aggregate",
    f"""WITH {t.WINDOWS_SQL}, k AS (SELECT *, extraction_success AS s FROM windows)
    SELECT entity_id, count(*) AS n_windows_theoretical, count(*) FILTER (s) AS n_windows_successful, count(*) FILTER (s) AS n_windows_used,
      round(count(*) FILTER (s) / count(*), 6) AS window_success_rate, round(avg(sig_mean) FILTER (s), 6) AS sig_mean_mean, round(coalesce(stddev_samp(sig_mean) FILTER (s), 0), 6) AS sig_mean_std,
      round(quantile_cont(sig_mean, 0.1) FILTER (s), 6) AS sig_mean_p10, round(quantile_cont(sig_mean, 0.5) FILTER (s), 6) AS sig_mean_p50, round(quantile_cont(sig_mean, 0.9) FILTER (s), 6) AS sig_mean_p90,
      CAST(sum(raw_rr_count) FILTER (s) AS DOUBLE) AS raw_rr_count_total, CAST(sum(valid_rr_count) FILTER (s) AS DOUBLE) AS valid_rr_count_total, CAST(sum(removed_rr_count) FILTER (s) AS DOUBLE) AS removed_rr_count_total
    FROM k GROUP BY 1 HAVING count(*) FILTER (s) >= 4""",
)
def _(spark, sf):
    df = aggregate.hourly_entity_table(t.windows(spark, sf), ["sig_mean"])
    return _rounded(df, ["window_success_rate", *[f"sig_mean_{s}" for s in STATS]])


@query("valid_count", f"WITH {STATS_SQL} SELECT entity_id, {COUNT_COLS} FROM stats")
def _(spark, sf):
    return aggregate.five_stats(_usable(spark, sf), KEY, t.FEATURES).select("entity_id", *[f"{f}_valid_count" for f in t.FEATURES])


@query(
    "first_non_null",
    f"""WITH {t.WINDOWS_SQL} SELECT entity_id, min(window_id) FILTER (sig_std IS NOT NULL) AS w, round(min_by(sig_std, window_id) FILTER (sig_std IS NOT NULL), 6) AS sig_std,
      min_by(window_status, window_id) AS window_status FROM windows GROUP BY 1""",
)
def _(spark, sf):
    w = t.windows(spark, sf).withColumn("w", F.when(F.col("sig_std").isNotNull(), F.col("window_id")))
    return _rounded(aggregate.first_by_window(w, KEY, ["w", "sig_std", "window_status"]), ["sig_std"])


@query("counter_sums", f"WITH {COUNTS_SQL} SELECT entity_id, coalesce(peaks, 0) AS raw_rpeak_count_total, coalesce(raw, 0) AS raw_rr_count_total, coalesce(good, 0) AS valid_rr_count_total, coalesce(gone, 0) AS removed_rr_count_total FROM counts")
def _(spark, sf):
    return aggregate.window_counts(t.windows(spark, sf), KEY).select("entity_id", *[f"{c}_total" for c in aggregate.COUNTERS])


@query("success_rate", f"WITH {COUNTS_SQL} SELECT entity_id, n AS n_windows_theoretical, round(ok / n, 6) AS window_success_rate FROM counts")
def _(spark, sf):
    return _rounded(aggregate.window_counts(t.windows(spark, sf), KEY).select("entity_id", "n_windows_theoretical", "window_success_rate"), ["window_success_rate"])


@query(
    "burden_ratio",
    f"""WITH {COUNTS_SQL} SELECT entity_id, pvc_count_24h, beats AS pvc_denominator_beats, round(ratio, 6) AS pvc_burden, coalesce(ratio > 0.2, FALSE) AS high_pvc_burden, status AS pvc_burden_status FROM burden""",
)
def _(spark, sf):
    df = aggregate.burden_ratio(t.windows(spark, sf), t.subjects(spark, sf).select("entity_id", "pvc_count_24h"), KEY)
    return _rounded(df, ["pvc_burden"])


@query("value_counts", f"WITH {t.SUBJECTS_SQL} SELECT coalesce(cause_raw, '<MISSING>') AS value, count(*) AS n FROM subjects GROUP BY 1")
def _(spark, sf):
    return distributions.value_counts(t.subjects(spark, sf), normalise_code(F.col("cause_raw")))


FIVE = ("count({c}) AS n, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max")


@query("five_number_summary", f"SELECT {FIVE.format(c='o_totalprice')} FROM orders")
def _(spark, sf):
    return _rounded(distributions.five_number_summary(t.read(spark, sf, "orders"), "o_totalprice"), ["p25", "median", "p75"])


@query("five_number_summary_split_table", f"SELECT {FIVE.format(c='l_extendedprice')} FROM lineitem")
def _(spark, sf):
    df = distributions.five_number_summary(t.read(spark, sf, "lineitem"), "l_extendedprice", hot_rows=1000)
    return _rounded(df, ["p25", "median", "p75"])


@query(
    "distribution_by_type",
    f"""SELECT o_orderstatus AS record_type, count(*) AS record_count, count(DISTINCT o_custkey) AS entity_count, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS p25,
      round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS p75, max(o_totalprice) AS max FROM orders GROUP BY 1""",
)
def _(spark, sf):
    o = t.read(spark, sf, "orders").withColumnRenamed("o_orderstatus", "record_type")
    return _rounded(distributions.distribution_by_type(o, "record_type", "o_custkey", "o_totalprice"), ["p25", "median", "p75"])


@query(
    "interval_bins",
    f"""WITH {t.SUBJECTS_SQL} SELECT count(*) FILTER (followup_days <= 90) AS le_90d, count(*) FILTER (followup_days > 90 AND followup_days <= 180) AS d91_180,
      count(*) FILTER (followup_days > 180 AND followup_days <= 365) AS d181_365, count(*) FILTER (followup_days > 365 AND followup_days <= 730) AS d366_730,
      count(*) FILTER (followup_days > 730) AS gt_730d FROM subjects WHERE cause_raw = '3'""",
)
def _(spark, sf):
    return distributions.interval_bins(t.subjects(spark, sf).filter("cause_raw = '3'"), "followup_days")


@query(
    "state_crosstab",
    f"WITH {t.ENDPOINTS_SQL} SELECT horizon_days, " + ", ".join(f"count(*) FILTER (state = '{s}') AS \"{s}\"" for s in STATES) + " FROM endpoints GROUP BY 1",
)
def _(spark, sf):
    return distributions.state_crosstab(build_endpoint(t.subjects(spark, sf), HORIZONS), "horizon_days", "state", STATES)


@query(
    "cohort_flow",
    f"""WITH {t.SUBJECTS_SQL}, f AS (SELECT *, source_valid AND followup_days IS NOT NULL AS ev FROM subjects)
    SELECT 0 AS stage_no, 'ALL_PATIENTS' AS stage, count(*) AS n, 0::BIGINT AS excluded_n, '' AS reason FROM f
    UNION ALL SELECT 1, 'HOLTER_AVAILABLE', count(*) FILTER (has_record), count(*) FILTER (NOT has_record), 'NO_HOLTER' FROM f
    UNION ALL SELECT 2, 'WITHOUT_AF', count(*) FILTER (has_record AND NOT af_flag), count(*) FILTER (has_record AND af_flag), 'AF' FROM f
    UNION ALL SELECT 3, 'EVALUABLE', count(*) FILTER (has_record AND NOT af_flag AND ev), count(*) FILTER (has_record AND NOT af_flag AND NOT ev), 'UNKNOWN_OUTCOME' FROM f""",
)
def _(spark, sf):
    has, af = F.col("has_record"), F.col("af_flag")
    ev = F.col("source_valid") & F.col("followup_days").isNotNull()
    stages = [
        ("ALL_PATIENTS", F.lit(True), F.lit(False), ""), ("HOLTER_AVAILABLE", has, ~has, "NO_HOLTER"), ("WITHOUT_AF", has & ~af, has & af, "AF"),
        ("EVALUABLE", has & ~af & ev, has & ~af & ~ev, "UNKNOWN_OUTCOME"),
    ]
    return distributions.flow_table(t.subjects(spark, sf), stages)


@query(
    "missing_counts",
    f"""WITH {t.SUBJECTS_SQL} SELECT 'followup_days' AS column_name, count(*) FILTER (followup_days IS NULL) AS missing FROM subjects
    UNION ALL SELECT 'cause_raw', count(*) FILTER (cause_raw IS NULL) FROM subjects UNION ALL SELECT 'pvc_count_24h', count(*) FILTER (pvc_count_24h IS NULL) FROM subjects""",
)
def _(spark, sf):
    return distributions.missing_counts(t.subjects(spark, sf), ["followup_days", "cause_raw", "pvc_count_24h"])


@query(
    "reason_explode_count",
    """WITH r AS (SELECT unnest(list_filter([CASE WHEN l_quantity < 10 THEN 'SHORT' END, CASE WHEN l_discount > 0.05 THEN 'CHEAP' END, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END],
      lambda x: x IS NOT NULL)) AS reason FROM lineitem) SELECT reason, count(*) AS n FROM r GROUP BY 1""",
)
def _(spark, sf):
    from ..functions.derive import reason_list

    r = reason_list((F.col("l_quantity") < 10, "SHORT"), (F.col("l_discount") > 0.05, "CHEAP"), (F.col("l_returnflag") == "R", "RETURNED"))
    return distributions.reason_counts(t.read(spark, sf, "lineitem").select(r.alias("reasons")), "reasons")


@query(
    "mean_prediction_pivot",
    f"WITH {t.SEEDED_SQL} SELECT entity_id, label, round(avg(score) FILTER (model = 'weak'), 6) AS weak, round(avg(score) FILTER (model = 'strong'), 6) AS strong FROM seeded GROUP BY 1, 2",
)
def _(spark, sf):
    return _rounded(distributions.mean_prediction_pivot(t.seeded_predictions(spark, sf), ["weak", "strong"]), ["weak", "strong"])


RUNS_SQL = t.SEEDED_SQL + "," + t.curve_sql("seeded", "model, seed")


def _runs(spark, sf):
    return run_metrics(t.seeded_predictions(spark, sf), ["model", "seed"])


@query(
    "metric_distribution",
    f"""WITH {RUNS_SQL} SELECT model, count(*) AS n, round(avg("AUC"), 6) AS mean, round(coalesce(stddev_samp("AUC"), 0), 6) AS std, round(min("AUC"), 6) AS min, round(max("AUC"), 6) AS max,
      round(quantile_cont("AUC", 0.025), 6) AS p2_5, round(quantile_cont("AUC", 0.5), 6) AS median, round(quantile_cont("AUC", 0.975), 6) AS p97_5 FROM ranked GROUP BY 1""",
)
def _(spark, sf):
    df = distributions.metric_distribution(_runs(spark, sf), ["model"], "AUC")
    return _rounded(df, ["mean", "std", "min", "max", "p2_5", "median", "p97_5"])


SUMMARY = ("count(*) AS seed_count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.025), 6) AS p2_5, "
           "round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.975), 6) AS p97_5")


@query(
    "repeated_summary",
    f"""WITH {RUNS_SQL}, long AS (SELECT model, 'AUC' AS metric, "AUC" AS v FROM ranked UNION ALL SELECT model, 'AP', "AP" FROM ranked) SELECT model, metric, {SUMMARY} FROM long GROUP BY 1, 2""",
)
def _(spark, sf):
    df = distributions.repeated_summary(_runs(spark, sf), ["AUC", "AP"])
    return _rounded(df, ["mean", "std", "min", "max", "p2_5", "p25", "median", "p75", "p97_5"])


@query(
    "paired_difference",
    f"""WITH {RUNS_SQL}, d AS (SELECT a.seed, a."AUC" - b."AUC" AS v FROM ranked a JOIN ranked b USING (seed) WHERE a.model = 'strong' AND b.model = 'weak')
    SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.025), 6) AS p2_5,
      round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.975), 6) AS p97_5, count(*) FILTER (v > 0) AS higher, count(*) FILTER (v = 0) AS equal, count(*) FILTER (v < 0) AS lower FROM d""",
)
def _(spark, sf):
    df = distributions.paired_summary(distributions.paired_difference(_runs(spark, sf), "AUC", "strong", "weak"))
    return _rounded(df, ["mean", "std", "min", "max", "p2_5", "median", "p97_5"])


@query("selection_frequency", "SELECT p_type AS selected_recipe, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return distributions.selection_frequency(t.read(spark, sf, "part").select(F.col("p_type").alias("selected_recipe")))


@query("label_feature_counts", "SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1")
def _(spark, sf):
    return t.read(spark, sf, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n")).orderBy("label")


@query(
    "numeric_difference_summary",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders WHERE o_orderpriority <> '5-LOW'),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1.5 ELSE o_totalprice END AS x, o_custkey::DOUBLE AS y FROM orders WHERE o_orderstatus <> 'P'),
    j AS (SELECT 'x' AS feature, a.x AS n, b.x AS o FROM a FULL JOIN b USING (k) UNION ALL SELECT 'y', a.y, b.y FROM a FULL JOIN b USING (k)), g AS (SELECT *, abs(n - o) AS gap FROM j)
    SELECT feature, count(gap) AS matched, count(*) FILTER (gap IS NULL) AS missing, round(avg(gap), 6) AS mean_abs_diff, round(max(gap), 6) AS max_abs_diff, round(quantile_cont(gap, 0.5), 6) AS median_abs_diff,
      round(corr(n, o), 6) AS correlation, count(*) FILTER (gap <= 1e-12) AS exact_match, CASE WHEN max(gap) <= 1e-12 THEN 'EXACT' WHEN bool_and(gap <= 1e-8 + 1e-6 * abs(o)) THEN 'NEAR' ELSE 'DIFFERENT' END AS comparison_class
    FROM g GROUP BY 1""",
)
def _(spark, sf):
    o = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), "o_orderstatus", "o_orderpriority")
    a = o.filter("o_orderpriority <> '5-LOW'")
    b = o.filter("o_orderstatus <> 'P'").withColumn("x", F.when(F.col("o_orderstatus") == "F", F.col("x") + 1.5).otherwise(F.col("x")))
    df = distributions.numeric_differences(a, b, "k", ["x", "y"])
    return _rounded(df, ["mean_abs_diff", "max_abs_diff", "median_abs_diff", "correlation"])


@query(
    "constant_column_scan",
    "SELECT 'l_quantity' AS column_name, count(DISTINCT l_quantity) <= 1 AS constant FROM lineitem UNION ALL SELECT 'zero', TRUE UNION ALL SELECT 'empty', TRUE",
)
def _(spark, sf):
    l = t.read(spark, sf, "lineitem").withColumns({"zero": F.col("l_tax") * 0, "empty": F.lit(None).cast("double")})
    return distributions.constant_columns(l, ["l_quantity", "zero", "empty"])


@query("deterministic_sort", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem ORDER BY ALL")
def _(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    return t.read(spark, sf, "lineitem").select(*cols).orderBy(*cols)


@query("rank_candidates", f"""WITH {RUNS_SQL} SELECT model || seed AS name, round("AUC", 6) AS "AUC", round("AP", 6) AS "AP" FROM ranked ORDER BY "AUC" DESC, "AP" DESC, name""")
def _(spark, sf):
    r = _runs(spark, sf).select(F.concat("model", F.col("seed").cast("string")).alias("name"), F.round("AUC", 6).alias("AUC"), F.round("AP", 6).alias("AP"))
    return distributions.rank_candidates(r, ["AUC", "AP"], "name")


@query(
    "argmax_with_name_tiebreak",
    "SELECT p_brand, p_name, p_size AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name) AS rn FROM part) WHERE rn = 1",
)
def _(spark, sf):
    p = t.read(spark, sf, "part").withColumnRenamed("p_size", "score")
    return distributions.best_by_score(p, ["p_brand"], "score", "p_name")


@query("top_features", "SELECT p_name, p_size, p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
def _(spark, sf):
    return distributions.top_features(t.read(spark, sf, "part").select("p_name", "p_size", "p_partkey"), "p_size", "p_partkey", 25)


@query(
    "tie_group_cumsum",
    f"""WITH {t.PREDICTIONS_SQL}, keyed AS (SELECT entity_id, label, score, nullif(model, 'rounded') AS model FROM preds),{t.curve_sql('keyed', 'model')}
    SELECT model, score, pos::DOUBLE AS pos, neg::DOUBLE AS neg, pos_before::DOUBLE AS pos_before, neg_before::DOUBLE AS neg_before, pos_total::DOUBLE AS pos_total FROM curve""",
)
def _(spark, sf):
    # Both models, one of them under a null run key, by value buckets.
    p = t.predictions(spark, sf).withColumn("model", F.nullif("model", F.lit("rounded")))
    return score_curve(p, ["model"], splits=value_splits(p, ["score"], 16)["score"]).select("model", "score", "pos", "neg", "pos_before", "neg_before", "pos_total")
