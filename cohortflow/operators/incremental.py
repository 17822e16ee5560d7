"""Reuse of finished work by fingerprint."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def pending_work(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Entities (`entity_id, fingerprint`) without a complete run of the same fingerprint whose row count agrees."""
    reusable = done.filter((F.col("status") == "COMPLETE") & (F.col("row_count") == F.col("stored_rows")))
    return inputs.join(reusable.select("entity_id", "fingerprint").distinct(), ["entity_id", "fingerprint"], "left_anti")


def reuse_report(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Every entity with REUSED, STALE, FAILED or NEW."""
    latest = done.groupBy("entity_id").agg(
        F.max(F.struct("finished_at", "fingerprint", "status", "row_count", "stored_rows")).alias("_d")
    )
    same = F.col("_d.fingerprint") == F.col("fingerprint")
    full = (F.col("_d.status") == "COMPLETE") & (F.col("_d.row_count") == F.col("_d.stored_rows"))
    state = F.when(F.col("_d").isNull(), "NEW").when(F.col("_d.status") == "FAILED", "FAILED").when(same & full, "REUSED").otherwise("STALE")
    return inputs.join(latest, "entity_id", "left").select("entity_id", "fingerprint", state.alias("work_state"))


def build_status(report: DataFrame) -> DataFrame:
    """COMPLETE unless an entity failed."""
    return report.agg(
        F.count("*").alias("entities"), F.count_if(F.col("work_state") == "FAILED").alias("failed")
    ).withColumn("status", F.when(F.col("failed") > 0, "DEGRADED").otherwise("COMPLETE"))


#: Parts of a store; a build rewrites the parts that hold a pending entity.
STORE_PARTS = 256


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or nothing where none was written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(path) if there else None


def _replace(new: DataFrame, old: DataFrame | None, touched: DataFrame, path: str, parts: int) -> None:
    """Write the parts that hold a touched entity anew: its new rows, and what the part held of others."""
    part = F.pmod(F.xxhash64("entity_id"), F.lit(parts)).cast("int")
    rows = new.withColumn("part", part)
    if old is not None:
        wanted = F.broadcast(touched.select(part.alias("part")).distinct())
        kept = old.join(wanted, "part", "left_semi").join(touched.select("entity_id"), "entity_id", "left_anti")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    rows = cut_lineage(rows)  # the parts it reads are the ones it replaces
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def incremental_build(inputs: DataFrame, build: Callable[[DataFrame], DataFrame], store: str, *, run: int, parts: int = STORE_PARTS) -> DataFrame:
    """Build what is pending and add it to the store; returns the work state of every input before the build.

    `inputs` has entity_id and fingerprint. `build` gets the pending ones and returns their result rows: entity_id, error_type
    and message (null for a good row) and results. An entity with an error row is recorded as FAILED with it, its results are
    left out, and the others go on; it is tried again by the next run, as is a changed fingerprint or a row count that does not
    agree. Rows are replaced part by part before the status is, so a build that breaks off is simply run again. Nothing
    pending: nothing is written. Entities that are no input any more stay in the store.
    """
    spark = inputs.sparkSession
    rows_path, status_path = os.path.join(store, "rows"), os.path.join(store, "status")
    status, rows = _stored(spark, status_path), _stored(spark, rows_path)
    if status is None:
        report = inputs.select("entity_id", "fingerprint", F.lit("NEW").alias("work_state"))
        pending = inputs.select("entity_id", "fingerprint")
    else:
        counts = rows.groupBy("entity_id").agg(F.count("*").alias("now")) if rows is not None else None
        known = status.join(counts, "entity_id", "left").withColumn("stored_rows", F.coalesce("now", F.lit(0))).drop("now", "part") if counts is not None else status.drop("part")
        known = cut_lineage(known)
        report = cut_lineage(reuse_report(inputs, known))
        pending = pending_work(inputs, known).select("entity_id", "fingerprint")
    pending = cut_lineage(pending)
    if pending.isEmpty():
        return report
    made = cut_lineage(build(pending))
    failed = made.filter(F.col("error_type").isNotNull()).groupBy("entity_id").agg(F.min(F.struct("error_type", "message")).alias("_e"))
    good = made.join(failed, "entity_id", "left_anti").drop("error_type", "message")
    counted = good.groupBy("entity_id").agg(F.count("*").alias("n"))
    facts = pending.join(failed, "entity_id", "left").join(counted, "entity_id", "left").select(
        "entity_id", "fingerprint", F.when(F.col("_e").isNull(), "COMPLETE").otherwise("FAILED").alias("status"), F.col("_e.error_type").alias("error_type"),
        F.col("_e.message").alias("message"), F.coalesce("n", F.lit(0)).alias("row_count"), F.coalesce("n", F.lit(0)).alias("stored_rows"), F.lit(run).alias("finished_at"))
    _replace(good, rows, pending, rows_path, parts)
    _replace(facts, status, pending, status_path, parts)
    return report
