import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import aggregate, distributions, folds, ordered, relational


def test_hourly_aggregate_fixture(spark):
    w = spark.createDataFrame(
        [("a", 0, "SUCCESS", 3, 3, 0, 1.0), ("a", 1, "SUCCESS", 4, 4, 0, 2.0), ("a", 2, "OUTSIDE_RECORD", 9, 9, 0, 3.0)],
        "entity_id string, window_id long, window_status string, raw_rr_count long, valid_rr_count long, removed_rr_count long, sig_mean double",
    )
    assert aggregate.hourly_entity_table(w, ["sig_mean"]).count() == 0
    r = aggregate.hourly_entity_table(w, ["sig_mean"], include_ineligible=True).first()
    assert (r.sig_mean_mean, r.sig_mean_p10, r.sig_mean_p50, r.sig_mean_p90) == pytest.approx((1.5, 1.1, 1.5, 1.9))
    assert r.sig_mean_std == pytest.approx(math.sqrt(0.5)) and r.window_success_rate == pytest.approx(2 / 3)
    assert (r.n_windows_theoretical, r.n_windows_successful, r.raw_rr_count_total) == (3, 2, 7.0)


SCHEMA = "entity_id string, window_id long, extraction_success boolean, qc_valid boolean, read_success boolean, raw_rpeak_count long, x double, x_valid boolean"


def test_full_aggregate_fixture(spark):
    w = spark.createDataFrame([("a", i, True, True, True, 100, float(i + 1), i != 2) for i in range(3)], SCHEMA)
    s = spark.createDataFrame([("a", 21.0), ("b", None)], "entity_id string, pvc_count_24h double")
    got = {r.entity_id: r for r in aggregate.entity_feature_table(w, ["x"], subjects=s).collect()}
    assert got["a"].x_valid_count == 2 and got["a"].x_mean == 1.5
    assert got["a"].pvc_burden == pytest.approx(0.07) and not got["a"].high_pvc_burden
    assert got["b"].n_windows_theoretical == 0 and got["b"].x_mean is None and got["b"].pvc_burden_status == "UNAVAILABLE_OFFICIAL_COUNT"


def test_one_value_has_zero_sd_and_nan_is_skipped(spark):
    v = spark.createDataFrame([("a", 5.0), ("a", float("nan")), ("a", float("inf")), ("b", None)], "entity_id string, x double")
    u = aggregate.usable_values(v, ["entity_id"], ["x"], F.lit(True))
    got = {r.entity_id: r for r in aggregate.five_stats(u, ["entity_id"], ["x"]).collect()}
    assert (got["a"].x_mean, got["a"].x_std, got["a"].x_valid_count) == (5.0, 0.0, 1)
    assert got["b"].x_std is None and got["b"].x_p50 is None and got["b"].x_valid_count == 0


def test_quantiles_of_a_hot_group_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"hot": np.round(rng.normal(size=3000), 2), "mid": rng.normal(size=300), "one": np.array([4.0])}
    rows = [(k, float(x), float(x * 2)) for k, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    probs = {"a": 0.025, "b": 0.5, "c": 0.9}
    for hot in (0, 500, 10_000):
        got = {r.k: r for r in ordered.exact_quantiles(df, ["k"], ["x", "y"], probs, hot_rows=hot, buckets=16).collect()}
        assert set(got) == set(data)
        for k, xs in data.items():
            for n, p in probs.items():
                assert got[k][f"x_{n}"] == pytest.approx(np.quantile(xs, p)) and got[k][f"y_{n}"] == pytest.approx(2 * np.quantile(xs, p))


def test_null_keys_and_infinities_are_the_same_on_both_ways(spark):
    inf = float("inf")
    rng = np.random.default_rng(7)
    rows = [(k, float(v)) for k in ("a", None) for v in np.round(rng.normal(size=400), 2)]
    rows += [("a", inf), ("a", -inf), ("a", -inf), (None, inf), ("b", inf), ("b", inf), ("b", 1.0), ("c", None), (None, None), ("d", -inf), ("d", inf)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    text = lambda d: sorted(map(repr, d.collect()))
    probs = {"a": 0.025, "b": 0.5, "c": 0.9}
    plain = ordered.exact_quantiles(df, ["k"], ["x"], probs, hot_rows=10_000)
    assert text(plain) == text(ordered.exact_quantiles(df, ["k"], ["x"], probs, hot_rows=0, buckets=16)) == text(ordered.exact_quantiles(df, ["k"], ["x"], probs, hot_rows=100))
    assert text(ordered.exact_quantiles(df, [], ["x"], probs, hot_rows=10_000)) == text(ordered.exact_quantiles(df, [], ["x"], probs, hot_rows=0, buckets=16))
    finite = df.filter("x is null or abs(x) < 1000")
    assert text(aggregate.five_stats(finite, ["k"], ["x"])) == text(aggregate.five_stats(finite, ["k"], ["x"], hot_rows=3))
    hours = df.withColumnRenamed("k", "entity_id")
    whole, cut = (aggregate.hourly_entity_table(hours, ["x"], min_successful=1, hot_rows=n).drop("x_mean", "x_std") for n in (10_000, 3))
    assert text(whole) == text(cut) and whole.count() == 5
    cols = ["k", "x", "n", "n_before", "n_total"]
    one = ordered.prefix_sums(df, ["k"], "x", {"n": F.count("*")}, splits=ordered.ONE_BUCKET).select(*cols)
    assert text(one) == text(ordered.prefix_sums(df, ["k"], "x", {"n": F.count("*")}, splits=ordered.value_splits(df, ["x"], 20)["x"]).select(*cols))
    assert text(one) == text(ordered.prefix_sums(df, ["k"], "x", {"n": F.count("*")}, splits=ordered.choose_splits(df, "x", hot_rows=5, buckets=7)).select(*cols))


def test_bucket_counts_follow_the_rows():
    assert [ordered.bucket_count(n) for n in (0, 10**6, 10**8, 10**13)] == [2, 5, 500, ordered.MAX_BUCKETS]


def test_folds_refuse_a_null_label(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(20)], "entity_id int, label int")
    with pytest.raises(Exception, match="label must not be null"):
        folds.stratified_folds(df, 2, [1]).collect()
    with pytest.raises(Exception, match="label must not be null"):
        folds.stratified_holdout(df, 0.5, 1).collect()
    assert folds.stratified_folds(df.filter("label is not null"), 2, [1, 2]).count() == 38


def test_prefix_sums_by_bucket_equal_plain_window(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i % 3), float(np.round(v, 2))) for i, v in enumerate(rng.exponential(size=2000))], "k int, v double")
    sums = {"n": F.count("*")}
    plain = ordered.prefix_sums(df, ["k"], "v", sums, splits=ordered.ONE_BUCKET)
    cut = ordered.prefix_sums(df, ["k"], "v", sums, splits=ordered.value_splits(df, ["v"], 20)["v"])
    cols = ["k", "v", "n", "n_before", "n_total"]
    assert sorted(map(tuple, plain.select(*cols).collect())) == sorted(map(tuple, cut.select(*cols).collect()))


def test_dense_index_has_no_gaps(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "entity_id")
    r = ordered.dense_index(df, "entity_id", seed=9).agg(F.min("row_index"), F.max("row_index"), F.countDistinct("row_index"), F.max("row_index_n")).first()
    n = df.count()
    assert tuple(r) == (0, n - 1, n, n)


def test_join_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(ValueError):
        relational.join_one_to_one(a, b, ["k"])
    assert relational.join_many_to_one(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        relational.assert_unique(spark.createDataFrame([(None, "z")], "k int, w string"), ["k"])
    with pytest.raises(ValueError):
        relational.stack_frames([a, b])


def test_five_numbers_of_few_values(spark):
    one = spark.createDataFrame([(3.0,), (float("nan"),)], "x double")
    assert tuple(distributions.five_number_summary(one, "x").select("n", "min", "p25", "median", "p75", "max").first()) == (1, 3.0, 3.0, 3.0, 3.0, 3.0)


def test_large_groups_have_bounds_of_their_own(spark):
    """50 groups of separate value ranges, and null keys, infinities and one constant group among them."""
    rng = np.random.default_rng(4)
    rows = [(g, float(g * 1000 + v)) for g in range(50) for v in np.round(rng.normal(0, 30, 400), 2)]
    rows += [(None, float(v)) for v in range(300)] + [(77, 5.0)] * 300 + [(78, float("inf")), (78, float("-inf")), (78, 1.0)] * 100
    df = spark.createDataFrame(rows, "k int, x double").repartition(6)
    bounds = ordered.group_bounds(df, ["k"], ["x"], rows=40)
    placed = ordered.with_bounds(df, bounds, ["k"]).withColumn("b", ordered.bucket_within(F.col("_bounds_x"), F.col("x")))
    sizes = placed.filter("k < 77 or k is null").groupBy("k", "b").count().collect()
    assert len(sizes) >= 50 * 9 and max(r["count"] for r in sizes) <= 2 * 40
    ordered_pairs = [(r.k, r.b, r.x) for r in placed.filter("k = 3").collect()]
    assert all(a[1] <= b[1] for a, b in zip(sorted(ordered_pairs, key=lambda r: r[2]), sorted(ordered_pairs, key=lambda r: r[2])[1:]))

    text = lambda d: sorted(map(str, d.collect()))
    sums = {"n": F.count("*")}
    plain = ordered.prefix_sums(df, ["k"], "x", sums)
    cut = ordered.prefix_sums(df, ["k"], "x", sums, hot_rows=10, bucket_rows=40)
    assert text(cut.select(*plain.columns)) == text(plain)
    probs = {"a": 0.1, "m": 0.5, "z": 0.975}
    usual, split = (ordered.exact_quantiles(df, ["k"], ["x"], probs, hot_rows=n).orderBy("k").collect() for n in (10**6, 100))
    assert [tuple(r) for r in usual] == [tuple(r) for r in split]


def test_split_summary_of_a_table_too_small_for_bounds(spark):
    rows = spark.range(30).withColumn("x", (F.col("id") * 7 % 30).cast("double"))
    one, split = (distributions.five_number_summary(rows, "x", hot_rows=n).select("n", "min", "p25", "median", "p75", "max").first() for n in (10**6, 5))
    assert tuple(one) == tuple(split) == (30, 0.0, 7.25, 14.5, 21.75, 29.0)
    assert ordered.prefix_sums(rows, [], "x", {"k": F.count("*")}, hot_rows=5).agg(F.max("k_before")).first()[0] == 29


def test_split_statistics_compute_their_values_once(spark):
    values = spark.range(40).selectExpr("id % 3 AS entity_id", "cast(id AS double) AS a")
    out = aggregate.five_stats(values, ["entity_id"], ["a"], hot_rows=5)
    assert "Range" not in out._jdf.queryExecution().analyzed().toString()  # nothing of it computes the values again
    plain = aggregate.five_stats(values, ["entity_id"], ["a"])
    assert [r.asDict() for r in out.select(plain.columns).orderBy("entity_id").collect()] == [r.asDict() for r in plain.orderBy("entity_id").collect()]
