"""Shards cut exactly between entities: the boundaries of a sequential writer, found without walking the rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a shard, and bytes of a shard file at which the write is refused.
SHARD_ROWS = 40_000
MAX_SHARD_BYTES = 25 * 1024 * 1024


def ordered_offsets(df: DataFrame, order: str, amount: str, out: str, parts: int = 64) -> DataFrame:
    """Add `out`: the sum of `amount` over all rows before a row in the order of a unique column, in range partitions."""
    placed = cut_lineage(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))  # one row per range
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return placed.join(F.broadcast(base), "_range").withColumn(out, (F.col("_base") + within).cast("long")).drop("_range", "_base")


def holders(points: DataFrame, point: str, intervals: DataFrame, start: str, size: str, tag: str, width: int) -> DataFrame:
    """Add `tag` of the interval [start, start + size) that holds a point; intervals cover the axis without overlap.

    Axis and intervals are cut into stretches of `width`; a stretch is one window, in which the last interval begun holds the
    point. No stretch has more than `width` intervals, and a long interval lies in as many stretches as it covers.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(size) - 1) / width)
    pieces = intervals.select(F.explode(F.sequence(first, last)).alias("_stretch"), F.col(start).alias("_start"), F.struct(F.col(tag).alias("tag")).alias("_tag"))
    rows = points.select(F.floor(F.col(point) / width).alias("_stretch"), F.col(point).alias("_at"), F.struct("*").alias("_row"))
    both = pieces.select("_stretch", F.col("_start").alias("_at"), F.lit(0).alias("_kind"), "_tag", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")).unionByName(
        rows.select("_stretch", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(pieces.schema["_tag"].dataType).alias("_tag"), "_row"))
    order = Window.partitionBy("_stretch").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_tag", ignorenulls=True).over(order)).filter(F.col("_kind") == 1)
    return found.select("_row.*", F.col("_found.tag").alias(tag))


def shard_starts(counts: DataFrame, shard_rows: int) -> DataFrame:
    """Entities that begin a shard, with `start` (rows before it): entity, start. `counts` has entity, rows, start.

    A writer that goes through the entities in order begins a new shard where the next entity would bring the shard over
    `shard_rows`. The entity at which the shard of an entity would be followed by the next one is where its start plus
    `shard_rows` falls; the chain of these from the first entity is found by pointer doubling, in as many rounds as the
    logarithm of the number of shards.
    """
    total = counts.agg(F.sum("rows")).first()[0] or 0
    target = F.greatest(F.col("start") + shard_rows, F.col("start") + F.col("rows"))
    asked = counts.select(F.col("entity").alias("source"), target.alias("at")).filter(F.col("at") < total)
    jump = cut_lineage(holders(asked, "at", counts, "start", "rows", "entity", shard_rows).select("source", F.col("entity").alias("next")))
    chain = cut_lineage(counts.filter(F.col("start") == 0).select("entity"))
    size = chain.count()
    while size:
        reached = jump.join(chain, F.col("source") == F.col("entity"), "left_semi").select(F.col("next").alias("entity"))
        chain = cut_lineage(chain.union(reached).distinct())
        if chain.count() == size:
            break
        size = chain.count()
        onward = jump.select(F.col("source").alias("next"), F.col("next").alias("further"))
        jump = cut_lineage(jump.join(onward, "next").select("source", F.col("further").alias("next")))
    return chain.join(counts.select("entity", "start"), "entity")


def shard_plan(df: DataFrame, *, entity: str = "entity_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every entity with its shard number from 0: `entity`, shard. An entity of more rows than a shard has one to itself.

    A null entity is an error. Empty table: empty plan.
    """
    stop = F.raise_error(F.lit(f"{entity} must not be null")).cast(df.schema[entity].dataType)
    rows = df.groupBy(F.coalesce(F.col(entity), stop).alias("entity")).agg(F.count("*").alias("rows"))
    counts = cut_lineage(ordered_offsets(rows, "entity", "rows", "start"))
    starts = shard_starts(counts, shard_rows).withColumn("one", F.lit(1).cast("long"))
    numbered = cut_lineage(ordered_offsets(starts, "entity", "one", "shard").select("start", "shard"))
    following = numbered.select((F.col("shard") - 1).alias("shard"), F.col("start").alias("until"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    spans = numbered.join(following, "shard", "left").select("shard", "start", (F.coalesce("until", F.lit(total)) - F.col("start")).alias("size"))
    placed = holders(counts.select("entity", F.col("start").alias("at")), "at", spans, "start", "size", "shard", shard_rows)
    return cut_lineage(placed.select(F.col("entity").alias(entity), F.col("shard").cast("long").alias("shard")))


def _write(df: DataFrame, plan: DataFrame, path: str, entity: str, order: list[Column]) -> DataFrame:
    """One file per shard below `path`, rows in order; returns shard, rows, bytes, first and last entity, read back from the files."""
    spark = df.sparkSession
    number = df.join(plan.withColumnRenamed(entity, "_entity"), F.col(entity) == F.col("_entity")).drop("_entity")
    number.repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"), F.count_distinct("_metadata.file_path").alias("files"),
        F.min(entity).alias("first_entity"), F.max(entity).alias("last_entity"))


def write_paired_shards(
    windows: DataFrame, features: DataFrame, path: str, *, shard_rows: int = SHARD_ROWS, max_bytes: int = MAX_SHARD_BYTES, keys: tuple[str, str] = ("entity_id", "window_id"),
) -> DataFrame:
    """Window and feature tables as shards of the same entities, `windows/shard=n` and `features/shard=n`; returns the manifest.

    Both tables must hold the same keys, each once; boundaries are those of a sequential writer (see `shard_starts`). A file of
    `max_bytes` or more is an error after the write: its shard is named and no manifest is returned.
    """
    entity, window = keys
    count = lambda df, side: df.groupBy(*keys).agg(F.count("*").alias(side))
    uneven = count(windows, "w").join(count(features, "f"), list(keys), "full").filter(~(F.col("w").eqNullSafe(1) & F.col("f").eqNullSafe(1)))
    first = uneven.orderBy(*keys).first()
    if first is not None:
        raise ValueError(f"windows and features must hold the same keys once each: {first}")
    plan = shard_plan(windows, entity=entity, shard_rows=shard_rows)
    parts = {side: cut_lineage(_write(df, plan, f"{path}/{side}", entity, [F.col(entity), F.col(window)])) for side, df in (("windows", windows), ("features", features))}
    for side, part in parts.items():
        large = part.filter((F.col("bytes") >= max_bytes) | (F.col("files") > 1)).orderBy("shard").first()
        if large is not None:
            raise RuntimeError(f"{side} shard {large['shard']} has {large['bytes']} bytes in {large['files']} files, the limit is {max_bytes}")
    other = parts["features"].select("shard", F.col("rows").alias("feature_rows"), F.col("bytes").alias("feature_bytes"), F.struct("first_entity", "last_entity").alias("_span"))
    joined = parts["windows"].join(other, "shard", "left")
    same = F.coalesce((F.col("rows") == F.col("feature_rows")) & (F.struct("first_entity", "last_entity") == F.col("_span")), F.lit(False))
    return joined.select("shard", "rows", "bytes", "first_entity", "last_entity", "feature_rows", "feature_bytes", same.alias("paired"))
