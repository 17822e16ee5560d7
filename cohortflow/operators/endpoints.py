"""Horizon outcomes that keep censoring and competing events apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import EVENT_TYPES, HORIZONS
from ..functions.parsing import decode, normalise_code
from .relational import assert_unique

REQUIRED = ["entity_id", "followup_days", "cause_raw", "source_valid"]


def _check(subjects: DataFrame, horizons: list[int]) -> None:
    if not set(horizons) <= set(HORIZONS):
        raise ValueError(f"horizons must be among {HORIZONS}")
    missing = sorted(set(REQUIRED) - set(subjects.columns))
    if missing:
        raise KeyError(f"endpoint source columns missing: {missing}")


def endpoint_state(followup: Column, cause: Column, valid: Column, horizon: Column) -> Column:
    """State of one entity at one horizon."""
    known = cause.isin(list(EVENT_TYPES))
    usable = F.coalesce(valid & (followup >= 0) & known, F.lit(False))
    within = followup <= horizon
    return (
        F.when(~usable, "UNKNOWN")
        .when(cause == "3", F.when(within, "POSITIVE").otherwise("NEGATIVE"))
        .when(cause != "0", F.when(within, "COMPETING_EVENT").otherwise("NEGATIVE"))
        .otherwise(F.when(followup >= horizon, "NEGATIVE").otherwise("CENSORED"))
    )


def state_label(state: Column) -> Column:
    """1 or 0 where the state can be evaluated, else null."""
    return F.when(state == "POSITIVE", 1).when(state == "NEGATIVE", 0)


def build_endpoint(subjects: DataFrame, horizons: list[int] = HORIZONS, *, check_keys: bool = True) -> DataFrame:
    """One row per entity and horizon: state, label where evaluable, time and event type.

    Horizons are a small fixed list, so each row is repeated in place; nothing is joined or shuffled.
    """
    _check(subjects, horizons)
    if check_keys:
        assert_unique(subjects, ["entity_id"], "subjects")
    coded = subjects.withColumn("_cause", normalise_code(F.col("cause_raw")))
    rows = coded.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    state = endpoint_state(F.col("followup_days"), F.col("_cause"), F.col("source_valid"), F.col("horizon_days"))
    return rows.select(
        "entity_id",
        "horizon_days",
        state.alias("state"),
        state_label(state).alias("label"),
        F.col("followup_days").alias("time_to_event"),
        F.coalesce(decode(F.col("_cause"), EVENT_TYPES), F.lit("UNKNOWN")).alias("event_type"),
    )


def endpoint_wide(subjects: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """One row per entity with a column block per horizon."""
    _check(subjects, horizons)
    cause = normalise_code(F.col("cause_raw"))
    cols = []
    for h in horizons:
        state = endpoint_state(F.col("followup_days"), cause, F.col("source_valid"), F.lit(h))
        cols += [
            state.alias(f"endpoint_{h}_state"),
            state_label(state).alias(f"endpoint_{h}_label"),
            F.col("followup_days").alias(f"endpoint_{h}_time"),
            F.coalesce(decode(cause, EVENT_TYPES), F.lit("UNKNOWN")).alias(f"endpoint_{h}_event_type"),
        ]
    return subjects.select("entity_id", *cols)


def competing_as_negative(endpoints: DataFrame) -> DataFrame:
    """Sensitivity recode: competing events become evaluable negatives."""
    recoded = F.when(F.col("state") == "COMPETING_EVENT", "NEGATIVE").otherwise(F.col("state"))
    return endpoints.withColumn("state", recoded).withColumn("label", state_label(F.col("state")))


def recode_check(original: DataFrame, recoded: DataFrame) -> DataFrame:
    """Rows that were evaluable and changed (must be none) and rows that became evaluable."""
    keys = ["entity_id", "horizon_days"]
    a = original.select(*keys, F.col("label").alias("_a"), F.col("state").alias("_sa"))
    b = recoded.select(*keys, F.col("label").alias("_b"))
    return a.join(b, keys).groupBy("horizon_days").agg(
        F.count_if(F.col("_a").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
        F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("added"),
        F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull() & (F.col("_sa") != "COMPETING_EVENT")).alias("added_wrongly"),
    )


def cause_specific_times(subjects: DataFrame, horizon: int = 365) -> DataFrame:
    """Truncated time and one event flag per cause; the other cause is censored at its own time."""
    state = endpoint_state(F.col("followup_days"), normalise_code(F.col("cause_raw")), F.col("source_valid"), F.lit(horizon))
    return subjects.withColumns(
        {
            "days": F.least(F.col("followup_days"), F.lit(float(horizon))),
            "event_primary": (state == "POSITIVE").cast("int"),
            "event_competing": (state == "COMPETING_EVENT").cast("int"),
        }
    )


def monotone_counts(subjects: DataFrame, cause: str = "3", horizons: list[int] = HORIZONS) -> DataFrame:
    """Events of one cause up to each horizon, and whether the counts never fall."""
    event = F.coalesce(normalise_code(F.col("cause_raw")) == cause, F.lit(False))
    counts = subjects.agg(*[F.count_if(event & (F.col("followup_days") <= h)).alias(f"n_{h}") for h in horizons])
    rising = F.lit(True)
    for a, b in zip(horizons, horizons[1:]):
        rising = rising & (F.col(f"n_{a}") <= F.col(f"n_{b}"))
    return counts.withColumn("monotone", rising)
