"""Entity tables from messy sources: merged codes, validity, availability and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RHYTHM_LABELS
from ..functions.derive import reason_list
from ..functions.parsing import decode


def merge_rhythm(df: DataFrame, long_code: str, short_code: str) -> DataFrame:
    """Prefer the long-record code; atrial fibrillation if either record says so; group label."""
    chosen = F.coalesce(F.col(long_code), F.col(short_code))
    af = F.coalesce(F.col(long_code) == 1, F.lit(False)) | F.coalesce(F.col(short_code) == 1, F.lit(False))
    label = decode(chosen.cast("int"), RHYTHM_LABELS)
    return df.withColumns(
        {
            "rhythm_code": chosen,
            "rhythm_decoded": label,
            "af_flag": af,
            "rhythm_group": F.when(af, "AF").when(label == "SINUS", "SINUS")
            .when(label == "ATRIAL_FLUTTER", "ATRIAL_FLUTTER").when(label == "PACEMAKER", "PACED")
            .otherwise("UNKNOWN"),
        }
    )


def source_valid(followup: Column, cause: Column, exit_code: Column, exit_text: Column) -> Column:
    """Follow-up not negative, cause known, and cause and exit code in agreement."""
    blank = F.coalesce(F.trim(exit_text) == "", F.lit(True))
    fits = F.when(cause.isin(1, 3, 6, 7), F.coalesce(exit_code == 3, F.lit(False))).when(
        cause == 0, blank | F.coalesce(exit_code.isin(0, 1, 2), F.lit(False))
    )
    return F.coalesce((followup >= 0) & fits, F.lit(False))


def availability(df: DataFrame, declared: list[str], intact: list[str]) -> DataFrame:
    """Compare each declared flag with the intact record, null-safe; status text."""
    same = F.lit(True)
    for flag, present in zip(declared, intact):
        same = same & F.col(flag).eqNullSafe(F.coalesce(F.col(present), F.lit(False)))
    return df.withColumn("mapping_consistent", same).withColumn(
        "integrity_status", F.when(same, "OK").otherwise("METADATA_FILE_MISMATCH")
    )


def eligibility(df: DataFrame, has_record: str = "has_record", flag: str = "af_flag") -> DataFrame:
    """False without a record or with the flag, null while signal checks are pending; reasons."""
    has = F.coalesce(F.col(has_record), F.lit(False))
    flagged = F.coalesce(F.col(flag), F.lit(False))
    return df.withColumns(
        {
            "eligible_primary": F.when(~has, F.lit(False)),
            "eligible_hrv": F.when(~has | flagged, F.lit(False)),
            "reason_primary": F.when(~has, "NO_HOLTER").otherwise("PENDING_SIGNAL_QC"),
            "reason_hrv": F.when(~has, "NO_HOLTER").when(flagged, "AF").otherwise("PENDING_SIGNAL_QC"),
        }
    )


def record_status(df: DataFrame) -> DataFrame:
    """Integrity reasons of a record: header, data file, size and digests; `OK` if none."""
    reasons = reason_list(
        (F.col("data_size") < F.col("expected_bytes"), "DAT_SHORTER_THAN_HEADER"),
        (~F.coalesce(F.col("header_ok"), F.lit(False)), "INVALID_HEADER"),
        (F.col("data_size").isNull(), "NO_DAT"),
        (F.col("header_digest").isNull() | F.col("data_digest").isNull(), "OFFICIAL_SHA256_MISSING"),
    )
    return df.withColumn("integrity_status", F.when(reasons == "", "OK").otherwise(reasons))


def provenance(records: DataFrame, dataset: str, version: str, code_version: str) -> DataFrame:
    """Record table narrowed to its origin, with the constants of the source."""
    return records.select(
        "entity_id",
        "record_id",
        "record_type",
        F.lit(dataset).alias("source_dataset"),
        F.lit(version).alias("source_version"),
        F.col("signal_path").alias("source_path"),
        F.col("data_digest").alias("source_sha256"),
        F.col("data_size").alias("source_file_size"),
        F.lit(code_version).alias("build_code_version"),
    )


def case_only_cohort(subjects: DataFrame, cause: str = "cause_raw", horizon: int = 365) -> DataFrame:
    """Valid events with a record, split by event time."""
    kept = subjects.filter(
        (F.col(cause) == "3") & F.coalesce(F.col("source_valid"), F.lit(False)) & F.coalesce(F.col("has_record"), F.lit(False))
    )
    early = F.col("followup_days") <= horizon
    return kept.select(
        "entity_id",
        "followup_days",
        early.cast("int").alias("label"),
        F.when(early, f"LE_{horizon}D_SCD").otherwise(f"GT_{horizon}D_SCD").alias("group"),
    )
