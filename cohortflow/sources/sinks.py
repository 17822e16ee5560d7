"""Writers: compressed parquet, entity-range shards, result text, digest lists and column dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .files import file_hash_table, relative_path
from .readers import finite_doubles
from .shards import SHARD_ROWS, shard_plan


def write_parquet_zstd(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_range_shards(df: DataFrame, path: str, *, shard_rows: int = SHARD_ROWS, keys: tuple[str, str] = ("entity_id", "window_id")) -> DataFrame:
    """Entity-sorted shards over contiguous entity ranges; returns the shard manifest.

    Boundaries are those of a sequential writer that begins a new shard where the next entity would bring it over
    `shard_rows` (`shards.shard_plan`): an entity never spans two shards, and one that holds more rows has a shard to itself.
    """
    entity, window = keys
    plan = shard_plan(df, entity=entity, shard_rows=shard_rows).select(F.col(entity).alias("_entity"), F.col("shard").alias("shard_no"))
    placed = df.join(plan, F.col(entity) == F.col("_entity")).drop("_entity")
    ordered = placed.repartition("shard_no").sortWithinPartitions("shard_no", entity, window)
    ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("shard_no").parquet(path)
    return shard_manifest(df.sparkSession.read.parquet(path), path, entity)


def shard_manifest(shards: DataFrame, base: str, entity: str = "entity_id") -> DataFrame:
    """Rows, bytes and first and last entity of every shard file, named by its path below the folder."""
    m = F.col("_metadata")
    return shards.groupBy(relative_path(m["file_path"], base).alias("shard")).agg(
        F.count("*").alias("rows"), F.max(m["file_size"]).alias("bytes"),
        F.min(entity).alias("first_entity"), F.max(entity).alias("last_entity"),
    )


def overlapping_shards(manifest: DataFrame, ranges: int = 64) -> DataFrame:
    """Shards whose first entity does not lie after all entities of the shards before it.

    Shards are ordered by their first entity in ranges; a range carries the largest last entity of the ranges before it,
    so neither pairs of shards nor one task for all of them are needed.
    """
    placed = cut_lineage(manifest.repartitionByRange(ranges, "first_entity", "shard").withColumn("_range", F.spark_partition_id()))
    ends = placed.groupBy("_range").agg(F.max("last_entity").alias("_last"))
    before = ends.select("_range", F.max("_last").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy("first_entity", "shard").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max("last_entity").over(inside), F.col("_carried"))
    return placed.join(F.broadcast(before), "_range").withColumn("_reached", reached).filter(F.col("first_entity") <= F.col("_reached")).select(*manifest.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header; NaN and infinities leave empty cells."""
    finite_doubles(df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """Result table as JSON lines; NaN and infinities become null."""
    finite_doubles(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def hash_manifest_lines(hashes: DataFrame) -> DataFrame:
    """`digest  path` lines in path order."""
    return hashes.orderBy("path").select(F.concat_ws("  ", "digest", "path").alias("value"))


def write_hash_manifest(df_or_hashes: DataFrame, path: str) -> None:
    hash_manifest_lines(df_or_hashes).write.mode("overwrite").text(path)


def folder_hash_manifest(spark, base: str, path: str) -> None:
    write_hash_manifest(file_hash_table(spark, base), path)


def schema_dictionary(df: DataFrame, source_columns: list[str]) -> DataFrame:
    """One row per column: type, whether nulls occur, whether it is derived; one pass over the data."""
    nulls = df.agg(*[F.bool_or(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in enumerate(df.schema)])
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.coalesce(F.col(f"n{i}"), F.lit(False)).alias("nullable"), F.lit(f.name not in source_columns).alias("derived"),
        )
        for i, f in enumerate(df.schema)
    ]
    return nulls.select(F.inline(F.array(*rows)))
