"""Column expressions for derived inputs: gates, flags, logs, indices, reasons and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_gate(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), x)


def binary_code_map(x: Column, valid: list[float], positive: list[float]) -> Column:
    """1.0 for a positive code, 0.0 for another valid code, else null."""
    return F.when(x.isin(valid), x.isin(positive).cast("double"))


def keep_binary(x: Column) -> Column:
    """0 and 1 stay, everything else is null."""
    return F.when(x.isin([0.0, 1.0]), x)


def threshold_flag(condition: Column, valid: Column) -> Column:
    return F.when(valid, condition.cast("double"))


def log1p_nonneg(x: Column) -> Column:
    return F.when(x >= 0, F.log1p(x))


def log_pos(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def surface_index(weight: Column, height: Column) -> Column:
    """sqrt(weight * height / 3600) for plausible weights and heights."""
    area = F.sqrt(weight * height / F.lit(3600.0))
    return F.when(weight.between(30.0, 250.0) & height.between(100.0, 230.0) & (area > 0), area)


def class_indicator(cls: Column, member: float, allowed: list[float]) -> Column:
    """1.0 in the class, 0.0 in another allowed class, null if unset; other classes stop the job."""
    return (
        F.when(cls.isNull(), F.lit(None).cast("double"))
        .when(cls.isin(allowed), (cls == member).cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit("unexpected class: "), cls.cast("string"))).cast("double"))
    )


def reason_list(*conditions: tuple[Column, str]) -> Column:
    """`;`-joined codes of the conditions that hold, in the given order; empty text if none does."""
    return F.concat_ws(";", *[F.when(cond, F.lit(code)) for cond, code in conditions])


def first_reason(conditions: list[tuple[Column, str]], otherwise: str) -> Column:
    """Code of the first condition that holds."""
    ladder = reduce(
        lambda acc, pair: acc.when(pair[0], F.lit(pair[1])),
        conditions[1:],
        F.when(conditions[0][0], F.lit(conditions[0][1])),
    )
    return ladder.otherwise(F.lit(otherwise))


def row_fingerprint(*cols: Column | str) -> Column:
    """SHA-256 over named fields as JSON text; nulls keep their place."""
    named = [F.col(c).cast("string").alias(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def all_finite(cols: list[str]) -> Column:
    """True if no listed column is null, NaN or infinite."""
    checks = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in cols]
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def interval_bin(days: Column) -> Column:
    """Follow-up band of a day count."""
    return (
        F.when(days <= 90, "le_90d").when(days <= 180, "d91_180").when(days <= 365, "d181_365")
        .when(days <= 730, "d366_730").when(days > 730, "gt_730d")
    )
