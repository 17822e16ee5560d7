"""Shard boundaries against a sequential writer."""

import random

import pytest
from pyspark.sql import functions as F

from cohortflow.sources import shards


def sequential(counts, limit):
    """Shard of every entity, going through them in order."""
    out, shard, held = {}, 0, 0
    for entity, n in sorted(counts.items()):
        if held and held + n > limit:
            shard, held = shard + 1, 0
        out[entity] = shard
        held += n
    return out


@pytest.mark.parametrize("case", ["even", "skewed", "large"])
def test_boundaries_equal_the_sequential_writer(spark, case):
    rng = random.Random(case)
    sizes = {"even": lambda: 3, "skewed": lambda: rng.choice([1, 1, 2, 5, 9, 30]), "large": lambda: rng.choice([1, 45, 100])}[case]
    counts = {f"e{i:03d}": sizes() for i in rng.sample(range(200), 70)}
    df = spark.createDataFrame([(e,) for e, n in counts.items() for _ in range(n)], "entity_id string").repartition(5)
    got = {r.entity_id: r.shard for r in shards.shard_plan(df, shard_rows=20).collect()}
    assert got == sequential(counts, 20)


def test_empty_and_null(spark):
    assert shards.shard_plan(spark.createDataFrame([], "entity_id string")).collect() == []
    with pytest.raises(Exception, match="must not be null"):
        shards.shard_plan(spark.createDataFrame([("a",), (None,)], "entity_id string")).collect()


def test_paired_files_and_limits(spark, tmp_path):
    windows = spark.range(300).select((F.col("id") % 13).alias("entity_id"), F.col("id").alias("window_id"), F.lit("x").alias("status"))
    features = windows.select("entity_id", "window_id", F.rand(1).alias("f1")).repartition(3)
    m = shards.write_paired_shards(windows, features, str(tmp_path / "a"), shard_rows=60).orderBy("shard").collect()
    want = sequential({i: 24 if i == 0 else 23 for i in range(13)}, 60)
    assert [r["rows"] for r in m] == [sum(24 if e == 0 else 23 for e, s in want.items() if s == k) for k in range(max(want.values()) + 1)]
    assert all(r.paired and r.feature_rows == r["rows"] for r in m)
    back = spark.read.parquet(str(tmp_path / "a" / "features")).withColumn("i", F.col("_metadata.row_index")).filter("shard = 1").orderBy("i").collect()
    assert [(r.entity_id, r.window_id) for r in back] == sorted((r.entity_id, r.window_id) for r in back)
    with pytest.raises(RuntimeError, match="limit is 100"):
        shards.write_paired_shards(windows, features, str(tmp_path / "b"), shard_rows=60, max_bytes=100)
    with pytest.raises(ValueError, match="same keys"):
        shards.write_paired_shards(windows, features.filter("window_id > 0"), str(tmp_path / "c"))
