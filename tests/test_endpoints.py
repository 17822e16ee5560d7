import pytest

from cohortflow.functions.constants import HORIZONS, WINDOW_FEATURES
from cohortflow.operators import endpoints, population
from cohortflow.operators.features import base_features, canonical_name, check_recipes, profile_columns

SCHEMA = "entity_id string, followup_days double, cause_raw string, source_valid boolean"
ROWS = [
    ("a", 50.0, "3", True), ("b", 800.0, "0", True), ("c", 50.0, "0", True), ("d", 50.0, "1", True),
    ("e", 50.0, "3", False), ("f", 800.0, "3", True), ("g", 800.0, "6", True),
]
STATES = {"a": "POSITIVE", "b": "NEGATIVE", "c": "CENSORED", "d": "COMPETING_EVENT", "e": "UNKNOWN", "f": "NEGATIVE", "g": "NEGATIVE"}


def test_states_at_every_horizon(spark):
    got = endpoints.build_endpoint(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS) * len(HORIZONS)
    for r in got:
        assert r.state == STATES[r.entity_id]
        assert r.label == {"POSITIVE": 1, "NEGATIVE": 0}.get(r.state)


def test_bad_horizon_missing_column_and_duplicates(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError):
        endpoints.build_endpoint(df, [100])
    with pytest.raises(KeyError):
        endpoints.build_endpoint(df.drop("cause_raw"))
    with pytest.raises(ValueError):
        endpoints.build_endpoint(df.unionByName(df))


def test_undefined_code_is_unknown_and_code_spelling(spark):
    df = spark.createDataFrame([("a", 10.0, "4", True), ("b", 10.0, "3,0", True), ("c", None, "3", True), ("d", -1.0, "3", True)], SCHEMA)
    got = {r.entity_id: r.state for r in endpoints.build_endpoint(df, [365]).collect()}
    assert got == {"a": "UNKNOWN", "b": "POSITIVE", "c": "UNKNOWN", "d": "UNKNOWN"}


def test_competing_recode_only_adds(spark):
    e = endpoints.build_endpoint(spark.createDataFrame(ROWS, SCHEMA))
    for r in endpoints.recode_check(e, endpoints.competing_as_negative(e)).collect():
        assert (r.changed, r.added, r.added_wrongly) == (0, 1, 0)


def _status(spark, subjects, features):
    s = spark.createDataFrame(subjects, "entity_id string, has_record boolean, af_flag boolean, followup_days double, cause_raw string, source_valid boolean")
    f = spark.createDataFrame(
        features, "entity_id string, n_windows_theoretical long, n_windows_successful long, n_windows_qc_valid long, raw_rpeak_count_total double, "
        "raw_rr_count_total double, valid_rr_count_total double, removed_rr_count_total double, high_pvc_burden boolean",
    )
    return {r.entity_id: r for r in population.analysis_status(s, f).collect()}


def test_status_ladder(spark):
    subjects = [
        ("ok", True, False, 800.0, "0", True), ("af", True, True, 800.0, "0", True), ("none", False, False, 800.0, "0", True),
        ("fail", True, False, 800.0, "0", True), ("burden", True, False, 800.0, "0", True), ("noqc", True, False, 50.0, "1", True),
    ]
    c = (10, 10, 5, 1.0, 1.0, 1.0, 0.0)
    features = [("ok", *c, False), ("af", *c, True), ("burden", *c, True), ("noqc", 10, 10, 0, 1.0, 1.0, 1.0, 0.0, False)]
    got = _status(spark, subjects, features)
    assert {k: r.eligibility_reason for k, r in got.items()} == {
        "ok": "ELIGIBLE", "af": "AF", "none": "NO_HOLTER", "fail": "PROCESSING_FAILED", "burden": "HIGH_PVC_BURDEN", "noqc": "NO_QC_VALID_WINDOWS",
    }
    assert got["ok"].model_365_included and got["ok"].model_365_exclusion_reason == "INCLUDED"


def test_population_needs_finite_features(spark):
    df = spark.createDataFrame(
        [("a", "NEGATIVE", True, 1.0), ("b", "POSITIVE", True, float("nan")), ("c", "CENSORED", True, 1.0), ("d", "POSITIVE", False, 1.0)],
        "entity_id string, endpoint_365_state string, eligible boolean, x double",
    )
    assert [(r.entity_id, r.label_365d) for r in population.analysis_population(df, ["x"]).collect()] == [("a", 0)]


def test_model_frame_keeps_evaluable_rows(spark):
    feats = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "entity_id string, x double")
    frame = population.prepare_model_frame(feats, spark.createDataFrame(ROWS[:4], SCHEMA), ["x"])
    assert sorted((r.entity_id, r.label) for r in frame.collect()) == [("a", 1), ("b", 0)]
    with pytest.raises(ValueError):
        population.prepare_model_frame(feats, spark.createDataFrame(ROWS[1:2], SCHEMA), ["x"])


def test_feature_names():
    assert len(WINDOW_FEATURES) == 20 and len(profile_columns()) == 100 and len(base_features("physiology_only")) == 18
    assert canonical_name("feature_08") == "mean_rr" and canonical_name("sdnn_p90") == "sdnn" and canonical_name("other") is None
    with pytest.raises(ValueError):
        check_recipes({"r": ["a", "a"]}, ["a"])
    with pytest.raises(ValueError):
        check_recipes({"r": [f"c{i}" for i in range(25)]}, [f"c{i}" for i in range(25)])
