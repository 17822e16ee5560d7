"""Queries over readers and writers.  Each writes a table to the shared scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..session import scratch_path
from ..sources import files, readers, shards, sinks
from . import tables as t
from .registry import query


#: Header files that one task writes, on average.
HEADERS_PER_TASK = 250


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    o = t.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    o.write.csv(path, header=True)
    return readers.scan_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


DELIMITED_SQL = """SELECT doc_id::VARCHAR AS doc_id, lang, text || CASE WHEN doc_id % 3 = 0 THEN ';"x"' ELSE '' END AS text, n_chars::VARCHAR AS n_chars FROM documents"""


def _delimited(spark, sf, path):
    """Whole texts: line breaks, separators and quotes inside quoted values; empty texts quoted, nulls not."""
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, ';"x"').otherwise(""))
    d = t.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", text.alias("text"), F.col("n_chars").cast("string").alias("n_chars"))
    d.write.csv(path, sep=";", header=True, encoding="UTF-8", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("scan_delimited_encoded", DELIMITED_SQL)
def _(spark, sf):
    path = scratch_path(spark, "delimited")
    _delimited(spark, sf, path)
    return readers.scan_delimited(spark, path)


@query("scan_delimited_split", DELIMITED_SQL)
def _(spark, sf):
    path = scratch_path(spark, "delimited")
    _delimited(spark, sf, path)
    return readers.scan_delimited(spark, path, split_bytes=0)


@query(
    "scan_line_list",
    "SELECT key, count(*) AS n FROM (SELECT 'blocks/' || l_suppkey || '/' || l_partkey AS key FROM lineitem) GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, sf):
    path = scratch_path(spark, "lines")
    l = t.read(spark, sf, "lineitem")
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" blocks\\"), "l_suppkey", F.lit("\\"), "l_partkey", F.lit("  "))).otherwise(F.concat(F.lit("blocks/"), "l_suppkey", F.lit("/"), "l_partkey"))
    l.select(line.alias("value")).unionByName(l.select(F.lit("  ").alias("value"))).write.text(path)
    return readers.line_list_duplicates(readers.scan_line_list(spark, path))


@query(
    "scan_hash_manifest",
    """SELECT 'p/' || page_id AS path, sha256(html) AS digest, 'LISTED' AS kind FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT NULL, NULL, 'REJECTED' FROM pages WHERE page_id % 5 = 0""",
)
def _(spark, sf):
    path = scratch_path(spark, "digests")
    p = t.read(spark, sf, "pages")
    digest = F.sha2("html", 256)
    good = F.concat(F.when(F.col("page_id") % 2 == 0, F.upper(digest)).otherwise(digest), F.lit("  *p\\"), "page_id")
    p.select(F.when(F.col("page_id") % 5 != 0, good).otherwise(F.concat(F.lit("bad "), "page_id")).alias("value")).write.text(path)
    parsed, rejected = readers.scan_hash_manifest(spark, path)
    none = F.lit(None).cast("string")
    return parsed.select("path", "digest", F.lit("LISTED").alias("kind")).unionByName(rejected.select(none.alias("path"), none.alias("digest"), F.lit("REJECTED").alias("kind")))


@query(
    "header_inventory",
    """WITH o AS (SELECT *, (o_orderkey % 3 + 1)::INT AS ch, 1000 + o_custkey AS n FROM orders)
    SELECT 'P' || o_orderkey AS record_id, CASE WHEN o_orderstatus <> 'P' THEN 'P' || o_orderkey END AS entity_id, CASE WHEN o_orderpriority <> '5-LOW' THEN ch END AS channel_count, CASE WHEN o_orderpriority <> '5-LOW' THEN 200.0::DOUBLE END AS fs,
      CASE WHEN o_orderpriority <> '5-LOW' THEN n END AS sample_count, CASE WHEN o_orderpriority <> '5-LOW' THEN round(n / 200.0, 6) END AS duration_sec, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE array_to_string(['X', 'Y', 'Z'][1:ch], '|') END AS leads,
      CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE CASE WHEN o_orderpriority = '2-HIGH' THEN 0 ELSE 2 END * n * ch END::BIGINT AS expected_bytes,
      concat_ws(';', CASE WHEN o_orderstatus = 'P' THEN 'UNPARSEABLE_PATIENT_ID' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'MALFORMED_RECORD_LINE' END, CASE WHEN o_orderpriority NOT IN ('5-LOW') AND o_orderstatus = 'F' THEN 'RECORD_NAME_MISMATCH' END,
        CASE WHEN o_orderpriority = '2-HIGH' THEN 'NON_BYTE_ALIGNED_SIGNAL_FORMAT' END) AS anomalies FROM o""".replace("'P' || o_orderkey AS record_id", "CASE WHEN o_orderstatus = 'P' THEN 'R' ELSE 'P' END || o_orderkey AS record_id"),
)
def _(spark, sf):
    o = t.read(spark, sf, "orders").withColumns({"ch": (F.col("o_orderkey") % 3 + 1).cast("int"), "n": F.col("o_custkey") + 1000})
    stem = F.concat(F.when(F.col("o_orderstatus") == "P", "R").otherwise("P"), "o_orderkey")
    name = F.when(F.col("o_orderstatus") == "F", "other").otherwise(stem)
    first = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(name, F.lit(" 3 200"))).otherwise(F.concat_ws(" ", name, "ch", F.lit("200/1"), "n"))
    bits = F.when(F.col("o_orderpriority") == "2-HIGH", "212+0").otherwise("16+0")
    lines = F.transform(F.slice(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), 1, F.col("ch")), lambda x: F.concat(stem, F.lit(".dat "), bits, F.lit(" 100 16 0 "), x))
    text = F.concat_ws("\r\n", F.lit("# made from orders"), first, lines)
    h = files.header_inventory(o.select(F.concat(F.lit("records/"), stem, F.lit(".hea")).alias("path"), text.alias("text")))
    return h.select(
        "record_id", "entity_id", "channel_count", "fs", "sample_count", F.round("duration_sec", 6).alias("duration_sec"), F.concat_ws("|", "lead_names").alias("leads"), "expected_bytes", F.concat_ws(";", "anomalies").alias("anomalies")
    )


@query(
    "read_headers",
    """SELECT 'S' || s_suppkey AS record_id, 1 + s_suppkey % 2 AS channel_count, 100.0::DOUBLE AS fs, 500 + s_suppkey AS sample_count, 2 * (1 + s_suppkey % 2) * (500 + s_suppkey) AS expected_bytes,
      CASE WHEN s_suppkey % 5 = 0 THEN 'UNPARSEABLE_PATIENT_ID;RECORD_NAME_MISMATCH' ELSE 'UNPARSEABLE_PATIENT_ID' END AS anomalies FROM supplier""",
)
def _(spark, sf):
    # One header file per supplier, written and read back.  So many small files need tasks by their number, not by their bytes,
    # and each task moves its own files to their place.
    path = scratch_path(spark, "headers")
    s = t.read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("h"), "s_suppkey")
    ch = 1 + F.col("s_suppkey") % 2
    name = F.when(F.col("s_suppkey") % 5 == 0, "other").otherwise(F.col("h"))
    line = F.concat(F.col("h"), F.lit(".dat 16 "))
    text = F.concat_ws("\n", F.concat_ws(" ", name, ch.cast("string"), F.lit("100"), (500 + F.col("s_suppkey")).cast("string")), F.concat(line, F.lit("X")), F.when(ch == 2, F.concat(line, F.lit("Y"))))
    tasks = max(spark.sparkContext.defaultParallelism, -(-s.count() // HEADERS_PER_TASK))
    s.select("h", text.alias("value")).repartition(tasks, "h").write.partitionBy("h").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    headers = files.read_headers(spark, path, "*.txt").withColumn("path", F.concat(F.regexp_extract("path", "h=(\\w+)/", 1), F.lit(".hea")))
    return files.header_inventory(headers).select("record_id", F.col("channel_count").cast("long").alias("channel_count"), "fs", "sample_count", "expected_bytes", F.concat_ws(";", "anomalies").alias("anomalies"))


@query("scan_json_report", "SELECT o_orderstatus AS status, count(*) AS orders, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(spark, sf):
    # One report file per status.
    path = scratch_path(spark, "json")
    o = t.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean"))
    report = F.to_json(F.struct("status", F.struct("orders", F.round("mean", 4).alias("mean")).alias("facts")))
    o.select(F.col("status").alias("s"), report.alias("value")).repartition("s").write.partitionBy("s").text(path)
    read = readers.scan_json_report(spark, path, "status string, facts struct<orders: bigint, mean: double>")
    absent = readers.scan_json_report(spark, path + "-absent", "status string, facts struct<orders: bigint, mean: double>")
    return read.unionByName(absent).select("status", "facts.orders", "facts.mean")


@query(
    "scan_sharded_dataset",
    """SELECT CASE WHEN s = 'P' THEN 'UNLISTED' ELSE 'DECLARED' END AS kind, sum(n)::BIGINT AS observed_rows, count(*) AS shards
      FROM (SELECT o_orderstatus AS s, o_orderkey % 5 AS part, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1 UNION ALL SELECT 'MISSING', 0, 1""",
)
def _(spark, sf):
    # Files of one write carry the same name in different folders; each is a shard of its own.
    path = scratch_path(spark, "shards")
    o = t.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5).alias("part"))
    o.repartition("status", "part").write.partitionBy("status", "part").parquet(path)
    shards = readers.scan_sharded(spark, path)
    listed = shards.groupBy("shard").agg(F.count("*").alias("rows"), F.min("o_orderstatus").alias("s")).filter("s <> 'P'").select("shard", "rows")
    ghost = o.agg(F.lit("lost.parquet").alias("shard"), F.count("*").alias("rows"))
    report = readers.shard_report(shards, listed.unionByName(ghost))
    kind = F.when(F.col("state") == "OK", "DECLARED").otherwise(F.col("state"))
    return report.groupBy(kind.alias("kind")).agg(F.coalesce(F.sum("observed_rows"), F.lit(0)).alias("observed_rows"), F.count("*").alias("shards"))


def _text_tree(spark, sf):
    """Pages as lines of text files, one file for every remainder of page_id by 16."""
    path = scratch_path(spark, "tree")
    p = t.read(spark, sf, "pages").select("page_id", (F.col("page_id") % 16).alias("g"), F.concat_ws(" ", F.col("page_id").cast("string"), F.sha2("html", 256)).alias("value"))
    p.repartition("g").sortWithinPartitions("g", "page_id").select("g", "value").write.partitionBy("g").text(path)
    return path


@query("file_hash_table", "SELECT (page_id % 16)::VARCHAR AS folder, sha256(string_agg(page_id || ' ' || sha256(html) || chr(10), '' ORDER BY page_id)) AS digest, sum(length(page_id::VARCHAR) + 66)::BIGINT AS length FROM pages GROUP BY 1")
def _(spark, sf):
    # Small files as values, the larger ones as streams.
    path = _text_tree(spark, sf)
    half = t.read(spark, sf, "pages").count() * 70 // 16
    return files.file_hash_table(spark, path, "*.txt", stream_bytes=half).select(F.regexp_extract("path", "g=([0-9]+)/", 1).alias("folder"), "digest", "length")


@query("folder_hash_manifest", "SELECT sha256(string_agg(page_id || ' ' || sha256(html) || chr(10), '' ORDER BY page_id)) AS digest, (page_id % 16)::VARCHAR AS folder FROM pages GROUP BY 2")
def _(spark, sf):
    # The digest list of a folder, written and read back; only the data files are of interest here.
    path, listed = _text_tree(spark, sf), scratch_path(spark, "listed")
    sinks.folder_hash_manifest(spark, path, listed)
    parsed, _ = readers.scan_hash_manifest(spark, listed)
    return parsed.filter(F.col("path").endswith(".txt")).select("digest", F.regexp_extract("path", "g=([0-9]+)/", 1).alias("folder"))


@query(
    "file_inventory",
    """SELECT 'OTHER' AS category, count(*) AS files, sum(n)::BIGINT AS bytes, max(n)::BIGINT AS largest FROM (SELECT page_id % 16 AS g, sum(length(page_id::VARCHAR) + 66) AS n FROM pages GROUP BY 1)""",
)
def _(spark, sf):
    return files.inventory_totals(files.file_inventory(spark, _text_tree(spark, sf), excluded=r"(^|/)[._]"))


@query("write_parquet_zstd", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def _(spark, sf):
    path = scratch_path(spark, "zstd")
    sinks.write_parquet_zstd(t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), path)
    return readers.scan_parquet(spark, path)


@query(
    "write_range_shards",
    "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS entities, 0::BIGINT AS split_entities, 0::BIGINT AS overlapping, 0::BIGINT AS out_of_order, TRUE AS all_caught FROM orders",
)
def _(spark, sf):
    path = scratch_path(spark, "range")
    o = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("window_id"))
    manifest = sinks.write_range_shards(o, path, shard_rows=max(1, o.count() // 6))
    back = readers.scan_sharded(spark, path)
    per = back.groupBy("entity_id").agg(F.countDistinct("shard").alias("s"))
    shifted = manifest.withColumn("first_entity", F.col("first_entity") - 1).withColumn("shard", F.concat("shard", F.lit("-copy")))
    m2 = sinks.overlapping_shards(manifest)
    copies = sinks.overlapping_shards(manifest.unionByName(shifted)).select(F.replace("shard", F.lit("-copy"), F.lit("")).alias("s")).distinct()
    rows = spark.read.parquet(path).select("entity_id", "window_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    order = quality.sort_order_check(rows, ["entity_id", "window_id"]).agg(F.sum("out_of_order").alias("out_of_order"))
    one = [
        manifest.agg(F.sum("rows").alias("rows")), per.agg(F.count("*").alias("entities"), F.count_if(F.col("s") > 1).alias("split_entities")),
        m2.agg(F.count("*").alias("overlapping")), order, copies.agg(F.count("*").alias("caught")), manifest.agg(F.count("*").alias("shards")),
    ]
    out = one[0].withColumn("_k", F.lit(1))
    for part in one[1:]:
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    return out.withColumn("all_caught", F.col("caught") == F.col("shards")).drop("_k", "caught", "shards")


SHARD_LIMIT = "(SELECT count(*) // 7 FROM orders)"


@query(
    "paired_range_shards",
    f"""WITH RECURSIVE per AS (SELECT o_custkey AS e, count(*) AS n, row_number() OVER (ORDER BY o_custkey) AS i FROM orders GROUP BY 1),
    walk AS (SELECT e, n, i, 0 AS shard, n AS held FROM per WHERE i = 1
      UNION ALL SELECT p.e, p.n, p.i, shard + CASE WHEN held + p.n > {SHARD_LIMIT} THEN 1 ELSE 0 END, CASE WHEN held + p.n > {SHARD_LIMIT} THEN p.n ELSE held + p.n END FROM walk w JOIN per p ON p.i = w.i + 1)
    SELECT shard::BIGINT AS shard, sum(n)::BIGINT AS rows, min(e) AS first_entity, max(e) AS last_entity, sum(n)::BIGINT AS feature_rows, TRUE AS paired, TRUE AS refused FROM walk GROUP BY shard""",
)
def _(spark, sf):
    # Windows and features of all orders; the byte limit is tried on a second write.
    o = t.read(spark, sf, "orders")
    windows = o.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("window_id"), F.col("o_orderstatus").alias("status"))
    features = o.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("window_id"), F.col("o_totalprice").cast("double").alias("f1"))
    limit = o.count() // 7
    made = shards.write_paired_shards(windows, features, scratch_path(spark, "paired"), shard_rows=limit)
    try:
        shards.write_paired_shards(windows, features, scratch_path(spark, "refused"), shard_rows=limit, max_bytes=64)
        refused = False
    except RuntimeError:
        refused = True
    return made.select("shard", "rows", "first_entity", "last_entity", "feature_rows", "paired", F.lit(refused).alias("refused"))


@query("sort_order_check", "SELECT 2::BIGINT AS files_with_disorder, count(*) AS rows, count(*) FILTER (o_custkey % 5 > 2) - 2 AS out_of_order FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "sorted")
    o = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("window_id"))
    # Five files; the rows of two of them run backwards.
    g = F.col("entity_id") % 5
    turned = F.when(g > 2, -F.col("window_id")).otherwise(F.col("window_id"))
    o.withColumns({"g": g, "a": F.when(g > 2, -F.col("entity_id")).otherwise(F.col("entity_id")), "b": turned}).repartition("g").sortWithinPartitions("g", "a", "b").drop("a", "b").write.partitionBy("g").parquet(path)
    rows = spark.read.parquet(path).select("entity_id", "window_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    found = quality.sort_order_check(rows, ["entity_id", "window_id"]).agg(F.count_if(F.col("out_of_order") > 0).alias("files_with_disorder"), F.sum("out_of_order").alias("out_of_order")).withColumn("_k", F.lit(1))
    return found.join(rows.agg(F.count("*").alias("rows")).withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("shard_manifest_check", "SELECT 'OK' AS verdict, count(DISTINCT o_orderstatus) - 1 AS shards FROM orders UNION ALL SELECT 'MISMATCH', 1 UNION ALL SELECT 'MISSING', 1")
def _(spark, sf):
    # The manifest of a partitioned write, whose files share one name, against facts per folder with one error.
    path = scratch_path(spark, "manifest")
    o = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("window_id"), F.col("o_orderstatus").alias("s"))
    o.repartition("s").write.partitionBy("s").parquet(path)
    m = sinks.shard_manifest(spark.read.parquet(path), path).withColumn("shard", F.regexp_extract("shard", "^s=(.)/", 1))
    facts = o.groupBy(F.col("s").alias("shard")).agg(F.count("*").alias("rows"), F.min("entity_id").alias("first_entity"), F.max("entity_id").alias("last_entity"))
    wrong = facts.withColumn("rows", F.when(F.col("shard") == "P", F.col("rows") + 1).otherwise(F.col("rows")))
    lost = o.agg(F.lit("lost").alias("shard"), F.count("*").alias("rows"), F.min("entity_id").alias("first_entity"), F.max("entity_id").alias("last_entity"))
    checked = quality.manifest_check(m.drop("bytes"), wrong.unionByName(lost), "shard", ["rows", "first_entity", "last_entity"])
    return checked.groupBy("verdict").agg(F.count("*").alias("shards"))


@query("write_csv_json", "SELECT 'csv' AS kind, count(*) AS rows, count(*) FILTER (o_orderstatus = 'P') AS nulls FROM orders UNION ALL SELECT 'json', count(*), count(*) FILTER (o_orderstatus = 'P') FROM orders")
def _(spark, sf):
    o = t.read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", float("inf")).otherwise(F.col("o_totalprice")).alias("x"))
    a, b = scratch_path(spark, "csv"), scratch_path(spark, "json")
    sinks.write_csv(o, a)
    sinks.write_json(o, b)
    schema = "o_orderkey long, x double"
    read = spark.read.csv(a, header=True, schema=schema).withColumn("kind", F.lit("csv")).unionByName(spark.read.schema(schema).json(b).withColumn("kind", F.lit("json")))
    return read.groupBy("kind").agg(F.count("*").alias("rows"), F.count_if(F.col("x").isNull()).alias("nulls"))


@query("write_hash_manifest", "SELECT sha256(html) || '  p/' || page_id AS value FROM pages")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    sinks.write_hash_manifest(t.read(spark, sf, "pages").select(F.concat(F.lit("p/"), "page_id").alias("path"), F.sha2("html", 256).alias("digest")), path)
    return spark.read.text(path)


@query(
    "schema_dictionary",
    f"""WITH {t.SUBJECTS_SQL} SELECT * FROM (VALUES (0, 'entity_id', 'bigint', FALSE, FALSE), (1, 'c_acctbal', 'double', FALSE, FALSE)) v(position, name, dtype, nullable, derived)
    UNION ALL SELECT 2, 'followup_days', 'double', bool_or(followup_days IS NULL), TRUE FROM subjects UNION ALL SELECT 3, 'cause_raw', 'string', bool_or(cause_raw IS NULL), TRUE FROM subjects""",
)
def _(spark, sf):
    return sinks.schema_dictionary(t.subjects(spark, sf).select("entity_id", "c_acctbal", "followup_days", "cause_raw"), ["entity_id", "c_acctbal"])
