"""Analysis status, survival-ready table, model population and model frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HORIZONS
from ..functions.derive import all_finite, first_reason
from .aggregate import COUNTERS
from .endpoints import build_endpoint, endpoint_wide
from .relational import assert_unique


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def eligibility_reason(has: Column, processed: Column, flagged: Column, high_burden: Column, qc_windows: Column) -> Column:
    """First failing reason in fixed priority, ELIGIBLE if none."""
    return first_reason(
        [
            (~has, "NO_HOLTER"),
            (~processed, "PROCESSING_FAILED"),
            (flagged, "AF"),
            (high_burden, "HIGH_PVC_BURDEN"),
            (F.coalesce(qc_windows, F.lit(0)) < 1, "NO_QC_VALID_WINDOWS"),
        ],
        "ELIGIBLE",
    )


def analysis_status(subjects: DataFrame, entity_features: DataFrame, *, horizons: list[int] = HORIZONS, primary: int = 365) -> DataFrame:
    """One row per subject: counts, flags, eligibility reason, outcome blocks and inclusion."""
    counts = ["n_windows_theoretical", "n_windows_successful", "n_windows_qc_valid", *[f"{c}_total" for c in COUNTERS]]
    optional = [c for c in ("processed", "high_pvc_burden", "pvc_burden", "tail_seconds") if c in entity_features.columns]
    side = entity_features.select("entity_id", *counts, *optional)
    base = subjects.select("entity_id", "has_record", "af_flag").join(side, "entity_id", "left")
    base = base.na.fill(0, subset=counts)
    has = _true("has_record")
    processed = _true("processed") if "processed" in optional else has & (F.col("n_windows_theoretical") > 0)
    high = _true("high_pvc_burden") if "high_pvc_burden" in optional else F.lit(False)
    reason = eligibility_reason(has, processed, _true("af_flag"), high, F.col("n_windows_qc_valid"))
    state = F.col(f"endpoint_{primary}_state")
    evaluable = state.isin("POSITIVE", "NEGATIVE")
    flagged = base.withColumns(
        {"has_record": has, "processed": processed, "af_flag": _true("af_flag"), "high_pvc_burden": high,
         "eligibility_reason": reason, "eligible": reason == "ELIGIBLE"}
    )
    return flagged.join(endpoint_wide(subjects, horizons), "entity_id").withColumns(
        {
            f"model_{primary}_included": F.col("eligible") & evaluable,
            f"model_{primary}_exclusion_reason": F.when(~F.col("eligible"), F.col("eligibility_reason"))
            .when(~evaluable, state).otherwise(F.lit("INCLUDED")),
        }
    )


def survival_ready(subjects: DataFrame, entity_features: DataFrame, status: DataFrame, *, horizon: int = 365, check_keys: bool = True) -> DataFrame:
    """All subjects with features and status, plus time, event type and state flags."""
    if check_keys:
        for name, df in (("subjects", subjects), ("features", entity_features), ("status", status)):
            assert_unique(df, ["entity_id"], name)
    taken = set(entity_features.columns) - {"entity_id"}
    extra = [c for c in status.columns if c not in taken]
    joined = subjects.select("entity_id").join(entity_features, "entity_id", "left").join(status.select(*extra), "entity_id", "left")
    state = F.col(f"endpoint_{horizon}_state")
    return joined.withColumns(
        {
            "time_to_event": F.col(f"endpoint_{horizon}_time"),
            "event_type": F.col(f"endpoint_{horizon}_event_type"),
            "censored": state == "CENSORED",
            "competing_event": state == "COMPETING_EVENT",
        }
    )


def optional_eligibility(df: DataFrame, col: str = "eligible") -> DataFrame:
    """Eligible rows where the column exists, else all rows."""
    return df.filter(_true(col)) if col in df.columns else df


def evaluable(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(F.col("state").isin("POSITIVE", "NEGATIVE") & F.col("label").isin(0, 1))


def processed_with_windows(entity_features: DataFrame) -> DataFrame:
    return entity_features.filter(_true("processed") & (F.coalesce(F.col("n_windows_successful"), F.lit(0)) > 0))


def analysis_population(ready: DataFrame, features: list[str], *, horizon: int = 365) -> DataFrame:
    """Evaluable, eligible rows with every feature finite, and their label."""
    state = F.col(f"endpoint_{horizon}_state")
    kept = ready.filter(state.isin("POSITIVE", "NEGATIVE") & _true("eligible") & all_finite(features))
    return kept.withColumn(f"label_{horizon}d", F.when(state == "POSITIVE", 1).otherwise(0))


def prepare_model_frame(
    entity_features: DataFrame, source: DataFrame, columns: list[str], *, horizon: int = 365, require_both: bool = True, check_keys: bool = True
) -> DataFrame:
    """Features joined to the evaluable outcome of one horizon.

    `source` is a subject table or an outcome table that is already built.
    """
    missing = sorted(set(columns) - set(entity_features.columns))
    if missing:
        raise ValueError(f"model feature columns missing: {missing}")
    outcome = source if {"state", "label"} <= set(source.columns) else build_endpoint(source, [horizon], check_keys=check_keys)
    if check_keys:
        assert_unique(entity_features, ["entity_id"], "features")
    usable = optional_eligibility(entity_features).select("entity_id", *[F.col(c).cast("double").alias(c) for c in columns])
    frame = evaluable(outcome).join(usable, "entity_id")
    if require_both:
        n = frame.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
        if not n["p"] or not n["n"]:
            raise ValueError("both classes are required")
    return frame


def population_audit(status: DataFrame, *, horizon: int = 365) -> DataFrame:
    return status.select(
        "entity_id",
        F.col(f"model_{horizon}_included").alias("included"),
        F.col(f"model_{horizon}_exclusion_reason").alias("reason"),
    )


def completeness(df: DataFrame, failed: Column, completed: Column) -> DataFrame:
    """Processing status of each entity."""
    return df.withColumn(
        "processing_status", F.when(failed, "FAILED").when(completed, "COMPLETE").otherwise("NOT_APPLICABLE")
    )
