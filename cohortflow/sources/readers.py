"""Readers of parquet, delimited text, line lists, digests, JSON reports and sharded sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import nan_to_null
from .files import relative_path

# Encodings in the order they are tried.
ENCODINGS = ["UTF-8", "windows-1252", "ISO-8859-1"]

# What stands for a value that is not there (two characters that Unicode keeps out of texts), so that quoted
# empty text stays text; and a way to write the quote's escape, without which Spark takes NUL for it and drops NULs beside quotes.
QUOTED = {"escape": '"', "nullValue": "\ufdd0\ufdd1", "charToEscapeQuoteEscaping": '"'}

#: Files of quoted text up to this size are one task each.
SPLIT_BYTES = 128 << 20

# Fixed value: one line of a digest list.
DIGEST_LINE = r"^([0-9a-fA-F]{64})\s+[*]?(.+?)\s*$"


def finite_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return finite_doubles(df.select(*columns) if columns else df)


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Comma text with a header line; the caller states the types."""
    return finite_doubles(spark.read.csv(path, header=True, schema=schema, mode="FAILFAST"))


def choose_encoding(spark: SparkSession, path: str) -> str:
    """First encoding of the list that decodes every line.

    The bytes of the lines are checked in place; only one flag comes back.
    """
    lines = spark.read.text(path, lineSep="\n")
    # Byte values that the windows-1252 code page leaves undefined.
    gaps = r"[\x{81}\x{8D}\x{8F}\x{90}\x{9D}]"
    flags = lines.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_and(~F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(gaps)), F.lit(True)).alias("cp1252"),
    ).first()
    return ENCODINGS[0] if flags["utf8"] else ENCODINGS[1] if flags["cp1252"] else ENCODINGS[2]


def _from_cp1252(df: DataFrame) -> DataFrame:
    """Text read byte for byte as Latin-1, with the bytes 80 to 9F turned into their windows-1252 characters."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", errors="ignore")) for b in range(0x80, 0xA0)]
    known = {a: c for a, c in pairs if c}
    source, target = "".join(known), "".join(known.values())
    names = {c: c.translate(str.maketrans(known)) for c in df.columns}
    return df.select(*[F.translate(F.col(f"`{c}`"), source, target).alias(n) for c, n in names.items()])


def scan_delimited(
    spark: SparkSession, path: str, *, sep: str = ";", encoding: str | None = None, quoted_breaks: bool = True, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Separated text as strings only; the encoding is found where none is given, a byte-order mark is dropped.

    Quoted values may hold separators, doubled quotes and line breaks.  A value of two quotes is empty text, one without
    quotes and without characters is null.  A file is one task, unless a file is larger than
    `split_bytes`: then records are put together from the lines of all splits (`records_across_splits`), as long as quotes
    stand only around whole values; text with stray quotes is read file by file.  `quoted_breaks=False` lets Spark split
    files that are known to have one record per line.
    """
    found = encoding or choose_encoding(spark, path)
    plain = "ISO-8859-1" if found == "windows-1252" else found
    options = {"sep": sep, "header": True, "encoding": plain, "inferSchema": False, "multiLine": quoted_breaks, **QUOTED}
    df = spark.read.csv(path, **options)
    if quoted_breaks and len(sep) == 1 and plain in ("UTF-8", "ISO-8859-1"):
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
        if largest > split_bytes:
            records = records_across_splits(spark, path, plain)
            if not records.filter(_stray_quote(F.col("record"), sep)).limit(1).count():
                df = _parsed(records.filter("not header").select("record"), df.columns, sep)
    if found == "windows-1252":
        df = _from_cp1252(df)
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})


def records_across_splits(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Records of quoted text as (`record`, `header`), read in as many tasks as the files have splits; empty lines go.

    A line break is inside a value where an odd number of quotes stands before it.  A first pass keeps two numbers per
    split: the parity of its quotes, and where a record last begins in it for either parity at its start.  Prefixes over
    the splits of a file then tell each split its state, so every line knows its record; only records of several lines
    are shuffled once more.  A split is at most `spark.sql.files.maxPartitionBytes`, and its lines are one sorted run.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("value"),
    )
    lines = raw.withColumn("value", F.decode("value", encoding))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("odd", (quotes % 2).cast("int"))
    in_split = Window.partitionBy("file", "block").orderBy("line")
    before = F.coalesce(F.sum("odd").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    placed = lines.withColumn("before", before)  # quotes before the line within its split, modulo 2

    # A line begins a record where `before` and the state of its split are both even or both odd.
    splits = placed.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("parity"), F.max(F.when(F.col("before") == 0, F.col("line"))).alias("last_even"), F.max(F.when(F.col("before") == 1, F.col("line"))).alias("last_odd"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("state", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    begun = F.when(F.col("state") == 0, F.col("last_even")).otherwise(F.col("last_odd"))
    states = splits.withColumn("begun", begun).select(
        "file", "block", "state", F.last("begun", ignorenulls=True).over(earlier).alias("open"), (F.min("block").over(Window.partitionBy("file")) == F.col("block")).alias("top")
    )
    known = placed.join(states, ["file", "block"])
    starts = F.col("before") == F.col("state")
    known = known.withColumn("start", F.coalesce(F.last(F.when(starts, F.col("line")), ignorenulls=True).over(in_split), F.col("open")))
    header = F.col("top") & (F.row_number().over(in_split) == 1)
    known = known.select("file", "start", "line", "value", starts.alias("starts"), "odd", header.alias("header"))

    alone = known.filter("starts and odd = 0").select(F.col("value").alias("record"), "header")
    parts = known.filter("not starts or odd = 1").groupBy("file", "start").agg(
        F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts"), F.bool_or("header").alias("header")
    )
    joined = parts.select(F.array_join("parts.value", "\n").alias("record"), "header")
    # A carriage return before the break belongs to the break.
    whole = alone.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return whole.filter("record <> ''")


def _stray_quote(record: Column, sep: str) -> Column:
    """Quotes that do not stand around a whole value: quoted stretches must touch separators, ends or each other only."""
    mark = "\u0001"
    s = "\\" + sep if not sep.isalnum() and sep != "\t" else sep
    marked = F.regexp_replace(record, '"[^"]*+"', mark)
    return marked.rlike(f'"|[^{s}{mark}]{mark}|{mark}[^{s}{mark}]')


def _parsed(records: DataFrame, names: list[str], sep: str) -> DataFrame:
    """Values of single records under the given names."""
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    value = F.from_csv("record", fields, {"sep": sep, **QUOTED, "multiLine": "true", "lineSep": "\n", "mode": "PERMISSIVE"})
    return records.select(value.alias("v")).select(*[F.col(f"v.c{i}").alias(n) for i, n in enumerate(names)])


def scan_line_list(spark: SparkSession, path: str) -> DataFrame:
    """Keys, one per line; blank lines dropped, backslashes turned."""
    lines = spark.read.text(path).select(F.replace(F.trim("value"), F.lit("\\"), F.lit("/")).alias("key"))
    return lines.filter("key <> ''")


def line_list_duplicates(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def parse_digest_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split `value` lines into (path, digest) and rejected lines."""
    text = lines.filter(F.trim("value") != "")
    good = F.col("value").rlike(DIGEST_LINE)
    parsed = text.filter(good).select(
        F.replace(F.regexp_extract("value", DIGEST_LINE, 2), F.lit("\\"), F.lit("/")).alias("path"),
        F.lower(F.regexp_extract("value", DIGEST_LINE, 1)).alias("digest"),
    )
    return parsed, text.filter(~good).select(F.col("value").alias("line"))


def scan_hash_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_digest_lines(spark.read.text(path))


def scan_json_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents (an object or a list of them per file) as rows; an absent or broken file gives no rows."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except Exception as exc:  # Spark reports a missing path while it resolves the read
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schema)
        raise
    whole = texts.filter(F.try_parse_json("value").isNotNull())
    return whole.select(F.inline(F.from_json("value", f"array<struct<{_struct_fields(schema)}>>")))


def _struct_fields(schema: str) -> str:
    """Column list in the form that stands inside a struct type."""
    return T.StructType.fromDDL(schema).simpleString()[len("struct<"):-1]


def scan_sharded(spark: SparkSession, base: str, pattern: str = "*.parquet") -> DataFrame:
    """All shards below a folder, each row with the path of its file below that folder."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(base)
    return df.select("*", relative_path(F.col("_metadata.file_path"), base).alias("shard"))


def shard_report(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared and observed rows per shard, with missing and unlisted shards marked."""
    seen = shards.groupBy("shard").agg(F.count("*").alias("observed_rows"))
    j = manifest.select("shard", F.col("rows").alias("declared_rows")).join(seen, "shard", "full")
    state = F.when(F.col("observed_rows").isNull(), "MISSING").when(F.col("declared_rows").isNull(), "UNLISTED")
    return j.select(
        "shard", "declared_rows", "observed_rows",
        (F.coalesce("observed_rows", F.lit(0)) - F.coalesce("declared_rows", F.lit(0))).alias("difference"),
        state.when(F.col("observed_rows") == F.col("declared_rows"), "OK").otherwise("ROW_DIFFERENCE").alias("state"),
    )
