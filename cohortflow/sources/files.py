"""Tables about files: digests, inventory and text record headers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import entity_id_from_name


#: Files above this many bytes are hashed as a stream.
STREAM_BYTES = 1 << 30
_CHUNK = 1 << 24


def relative_path(path: Column, base: str) -> Column:
    """Path text below the base folder; scheme and host do not matter."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/", base).rstrip("/") + "/"
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return F.when(plain.startswith(root), F.substring(plain, len(root) + 1, 1_000_000)).otherwise(plain)


def binary_files(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    )


def file_hash_table(spark: SparkSession, base: str, pattern: str = "*", *, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """SHA-256 and length of every file below a folder.

    Files of up to `stream_bytes` are read by Spark as one value; larger ones are opened by the task that owns the path and
    hashed in chunks, so no file is held whole.
    """
    found = binary_files(spark, base, pattern)
    small = found.filter(F.col("length") <= stream_bytes).select("path", F.sha2("content", 256).alias("digest"), "length")
    large = found.filter(F.col("length") > stream_bytes).select("path", "length").repartition("path").mapInArrow(_stream_digests, "path string, digest string, length long")
    return small.unionByName(large).select(relative_path(F.col("path"), base).alias("path"), "digest", "length")


def _stream_digests(batches):
    import hashlib
    from urllib.parse import quote

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            store, place = fs.FileSystem.from_uri(quote(path, safe=":/"))
            state = hashlib.sha256()
            with store.open_input_stream(place) as stream:
                while chunk := stream.read(_CHUNK):
                    state.update(chunk)
            digests.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), batch.column(1)], ["path", "digest", "length"])


def file_inventory(spark: SparkSession, base: str, excluded: str | None = None) -> DataFrame:
    """Path, length and category of every file; contents are not read."""
    files = binary_files(spark, base).select(relative_path(F.col("path"), base).alias("path"), "length")
    ext = F.lower(F.regexp_extract("path", r"[.]([A-Za-z0-9]+)$", 1))
    category = (
        F.when(ext == "parquet", "TABLE").when(ext.isin("csv", "json", "yaml", "md"), "REPORT")
        .when(ext == "hea", "HEADER").otherwise("OTHER")
    )
    out = F.col("path").rlike(excluded) if excluded else F.lit(False)
    return files.withColumns({"category": category, "excluded": out})


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.filter(~F.col("excluded")).groupBy("category").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("length").alias("largest")
    )


def read_headers(spark: SparkSession, base: str, pattern: str = "*.hea") -> DataFrame:
    """Header texts with their path, one row per file."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(base, wholetext=True)
    return df.select(relative_path(F.col("_metadata.file_path"), base).alias("path"), F.col("value").alias("text"))


def header_inventory(headers: DataFrame) -> DataFrame:
    """One row per header (`path, text`): rate, samples, channels, expected bytes per data file, anomaly codes.

    The record line gives id, channel count, rate and samples; each further line gives
    one channel: file, format and, last, its name.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[.][^.]*$", "")
    lines = F.filter(
        F.transform(F.split(F.regexp_replace("text", "^﻿", ""), r"\r\n|\r|\n"), lambda x: F.trim(x)),
        lambda x: (x != "") & ~x.startswith("#"),
    )
    base = headers.select("path", stem.alias("record_id"), entity_id_from_name(stem).alias("entity_id"), lines.alias("_l"))
    fields = F.split(F.get("_l", F.lit(0)), r"\s+")
    whole = r"^[+-]?[0-9]+$"
    rate = F.split(F.get("_f", F.lit(2)), "/")[0]
    first = base.withColumn("_f", fields).withColumns(
        {
            "_empty": F.size("_l") == 0,
            "_short": (F.size("_l") > 0) & (F.size("_f") < 4),
            "channel_count": F.when(F.size("_f") >= 4, F.get("_f", F.lit(1)).try_cast("int")),
            "fs": F.when(F.size("_f") >= 4, rate.try_cast("double")),
            "sample_count": F.when(F.size("_f") >= 4, F.get("_f", F.lit(3)).try_cast("long")),
        }
    )
    readable = F.col("channel_count").isNotNull() & F.col("fs").isNotNull() & F.col("sample_count").isNotNull()
    named = first.withColumns(
        {
            "_ok": readable,
            "_bad_numbers": ~F.col("_empty") & ~F.col("_short") & ~readable,
            "_other_name": readable & (F.element_at(F.split(F.get("_f", F.lit(0)), "/"), -1) != F.col("record_id")),
            "_c": F.when(readable, F.slice("_l", 2, F.greatest(F.col("channel_count"), F.lit(0)))).otherwise(F.array().cast("array<string>")),
        }
    )
    channels = F.transform(
        F.transform("_c", lambda x: F.split(x, r"\s+")),
        lambda t: F.struct(
            (F.size(t) >= 2).alias("ok"),
            F.when(F.size(t) >= 2, t[0]).alias("file"),
            F.when(F.size(t) >= 2, F.element_at(t, -1)).alias("lead"),
            F.when(F.size(t) >= 2, F.regexp_extract(F.get(t, F.lit(1)), "^([0-9]+)", 1).try_cast("int")).alias("bits"),
        ),
    )
    parsed = named.withColumn("_ch", channels)
    usable = F.filter("_ch", lambda x: x["ok"] & (x["bits"] % 8 == 0))

    def any_channel(test) -> Column:
        return F.exists("_ch", test)

    anomalies = F.array_compact(
        F.array(
            F.when(F.col("entity_id").isNull(), "UNPARSEABLE_PATIENT_ID"),
            F.when(F.col("_empty"), "EMPTY_HEADER"),
            F.when(F.col("_short"), "MALFORMED_RECORD_LINE"),
            F.when(F.col("_bad_numbers"), "UNPARSEABLE_RECORD_LINE"),
            F.when(F.col("_other_name"), "RECORD_NAME_MISMATCH"),
            F.when(F.col("_ok") & (F.size("_c") != F.col("channel_count")), "SIGNAL_LINE_COUNT_MISMATCH"),
            F.when(any_channel(lambda x: ~x["ok"]), "MALFORMED_SIGNAL_LINE"),
            F.when(any_channel(lambda x: x["ok"] & x["bits"].isNull()), "UNPARSEABLE_SIGNAL_FORMAT"),
            F.when(any_channel(lambda x: x["ok"] & (x["bits"] % 8 != 0)), "NON_BYTE_ALIGNED_SIGNAL_FORMAT"),
        )
    )
    names = F.array_sort(F.array_distinct(F.transform(F.filter("_ch", lambda x: x["ok"]), lambda x: x["file"])))
    per_file = F.transform(
        names,
        lambda f: F.struct(
            f.alias("file"),
            F.aggregate(
                F.filter(usable, lambda x: x["file"] == f), F.lit(0).cast("long"),
                lambda acc, x: acc + F.col("sample_count") * (x["bits"] / 8).cast("long"),
            ).alias("bytes"),
        ),
    )
    return parsed.select(
        "path", "record_id", "entity_id", "channel_count", "fs", "sample_count",
        F.when(F.col("fs") > 0, F.col("sample_count") / F.col("fs")).alias("duration_sec"),
        F.transform(F.filter("_ch", lambda x: x["ok"]), lambda x: x["lead"]).alias("lead_names"),
        per_file.alias("data_files"),
        F.aggregate(per_file, F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"]).alias("expected_bytes"),
        anomalies.alias("anomalies"),
    )
