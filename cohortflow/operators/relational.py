"""Joins with checked cardinality, key spines and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """The same frame; raises if a key is null or repeated."""
    wrong = df.groupBy(*keys).count().filter(" or ".join(["count > 1", *[f"`{k}` is null" for k in keys]]))
    if not wrong.isEmpty():
        raise ValueError(f"{name}: {keys} must be non-null and unique")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    assert_unique(left, keys, "left side")
    assert_unique(right, keys, "right side")
    return left.join(right, keys, how)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join against a side whose key is checked to be unique."""
    return left.join(assert_unique(right, keys, "right side"), keys, "left")


BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow side whose counted rows stay within the bound, else the side as it is."""
    return F.broadcast(df) if df.count() <= max_rows else df


def lookup(left: DataFrame, right: DataFrame, keys: list[str], kind: Column, prefix: str) -> DataFrame:
    """Left join of the right rows of one kind, their columns prefixed."""
    side = right.filter(kind)
    renamed = side.select(*keys, *[F.col(c).alias(prefix + c) for c in side.columns if c not in keys])
    return left.join(renamed, keys, "left")


def outer_with_indicator(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full join of one value column with sides present, agreement and the reason code."""
    a = left.select(*keys, F.col(value).alias(f"{value}_new"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias(f"{value}_old"), F.lit(True).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    agrees = both & F.coalesce(F.col(f"{value}_new") == F.col(f"{value}_old"), F.lit(False))
    return a.join(b, keys, "full").select(
        *keys,
        f"{value}_new",
        f"{value}_old",
        F.col("_l").isNotNull().alias("in_new"),
        F.col("_r").isNotNull().alias("in_old"),
        agrees.alias("agreement"),
        F.when(F.col("_r").isNull(), "NEW_ONLY").when(F.col("_l").isNull(), "OLD_ONLY")
        .when(agrees, "MATCH").otherwise("GROUP_MISMATCH").alias("reason"),
    )


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by only one side, tagged with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_left = a.join(b, keys, "left_anti").withColumn("side", F.lit("LEFT_ONLY"))
    only_right = b.join(a, keys, "left_anti").withColumn("side", F.lit("RIGHT_ONLY"))
    return only_left.unionByName(only_right)


def key_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of shared keys and of keys on one side only."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return a.join(b, keys, "full").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("shared"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def key_spine(keys: list[str], *frames: DataFrame) -> DataFrame:
    """Every non-null key that occurs in any frame, once."""
    spine = frames[0].select(*keys)
    for frame in frames[1:]:
        spine = spine.unionByName(frame.select(*keys))
    return spine.dropna(subset=keys).distinct()


def stack_frames(frames: list[DataFrame]) -> DataFrame:
    """Union of frames whose schemas must be the same."""
    first = frames[0]
    for frame in frames[1:]:
        if [(f.name, f.dataType) for f in frame.schema] != [(f.name, f.dataType) for f in first.schema]:
            raise ValueError("frames to stack must share one schema")
    out = first
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide columns to (name, value) rows in one pass."""
    return df.unpivot(ids, cols, name, value)
