"""Stratified folds and hold-outs from seeded hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import HASH_DIGITS, hash_rank


def _labelled(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Ids and labels; the job stops at a null label."""
    stop = F.raise_error(F.lit(f"{label} must not be null")).cast(df.schema[label].dataType)
    return df.select(id_col, F.coalesce(F.col(label), stop).alias(label))


def stratified_folds(df: DataFrame, k: int, seeds: list[int], *, id_col: str = "entity_id", label: str = "label", digits: int = HASH_DIGITS) -> DataFrame:
    """Rows per seed with a fold 1..k, class balance kept in every fold.

    Each class is dealt out in hash order.  Ranks come from hash buckets, so a class
    of any size is ranked in parallel, and all seeds share one job.  A null label is an error.
    """
    if k < 2:
        raise ValueError("k must be at least two")
    rows = _labelled(df, id_col, label).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    ranked = hash_rank(rows, ["seed", label], id_col, F.col("seed"), digits=digits)
    return ranked.select(id_col, label, "seed", (F.col("rank") % k + 1).cast("int").alias("fold"))


def class_sizes_ok(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Whether both classes have at least k members."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative")
    ).withColumn("enough", F.least("positive", "negative") >= k)


def validate_folds(folds: DataFrame, *, id_col: str = "entity_id", label: str = "label") -> DataFrame:
    """Per seed and fold: sizes and classes on both sides; and entities not tested exactly once."""
    per_fold = folds.groupBy("seed", "fold").agg(
        F.count("*").alias("test_n"), F.count_if(F.col(label) == 1).alias("test_positive")
    )
    totals = folds.groupBy("seed").agg(
        F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p")
    )
    repeats = folds.groupBy("seed", id_col).count().groupBy("seed").agg(F.count_if(F.col("count") != 1).alias("repeated"))
    test_neg = F.col("test_n") - F.col("test_positive")
    train_pos, train_neg = F.col("_p") - F.col("test_positive"), F.col("_n") - F.col("_p") - test_neg
    return per_fold.join(totals, "seed").join(repeats, "seed").select(
        "seed", "fold", "test_n", "test_positive",
        (F.col("_n") - F.col("test_n")).alias("train_n"), train_pos.alias("train_positive"), "repeated",
        ((F.least("test_positive", test_neg) > 0) & (F.least(train_pos, train_neg) > 0) & (F.col("repeated") == 0)).alias("valid"),
    )


def stratified_holdout(df: DataFrame, fraction: float, seed: int, *, id_col: str = "entity_id", label: str = "label") -> DataFrame:
    """Mark the first `fraction` of every class, in hash order, as test rows."""
    ranked = hash_rank(_labelled(df, id_col, label), [label], id_col, seed)
    return ranked.select(
        id_col, label, F.when(F.col("rank") < F.ceil(F.col("rank_n") * F.lit(float(fraction))), "test").otherwise("train").alias("part")
    )
