"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import WHITE, carried, let, lower_ascii, opened, text_of, written


def line_key(line: Column) -> Column:
    """A line without surrounding white space, A-Z lower-cased."""
    return lower_ascii(F.trim(line, F.lit(WHITE)))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a key of at least `min_chars` code points: doc_id, row_hash (of the text), pos, h1, h2 (128 bits of the key)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop every line whose key stands in at least `min_docs` documents, but not in the largest doc_id that holds it.

    Lines are exploded, hashed to 128 bits and counted by distinct doc_id; only hashes and positions are shuffled for that, and
    each document's text meets the positions it loses once. Returns the input's columns with `text` replaced, and `n_lines`
    (before dropping) and `n_dropped`, both long.

    Null text: one empty line, null text stays null. Null doc_id: all such rows count as one document, smaller than any other.
    Repeated rows: one document; rows of one doc_id with different texts also count once, and each loses its own lines.
    Empty table: empty result. Clashing `n_lines` or `n_dropped` columns are replaced. Very long texts: linear in the lines.
    """
    lines = line_hashes(docs.select("doc_id", "text"), min_chars)
    holders = lines.select("h1", "h2", "doc_id").distinct()
    frequent = holders.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    frequent = written(frequent.select("h1", "h2", "keeper"), "frequent")  # read from a table, so Spark can split a hash that a third of all lines have
    lost = lines.join(frequent, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("row_hash").alias("lost_hash")).agg(F.collect_set("pos").alias("lost_pos"))

    rows = carried(docs, id=F.col("doc_id"), row_hash=F.xxhash64("text"))
    joined = rows.join(lost, rows["id"].eqNullSafe(lost["lost_id"]) & (rows["row_hash"] == lost["lost_hash"]), "left")
    text = F.col("_row.text")

    def rest(lines: Column) -> Column:
        """array_except hashes the positions, so this stays linear in the number of lines."""
        positions = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost_pos"))
        return F.array_join(F.transform(positions, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col("lost_pos").isNull(), text).otherwise(let(F.split(text, "\n", -1), rest))
    n_lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")
    return opened(joined, docs.columns, text=kept, n_lines=n_lines, n_dropped=F.coalesce(F.size("lost_pos"), F.lit(0)).cast("long"))
