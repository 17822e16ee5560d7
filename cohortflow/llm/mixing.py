"""Mixing sources to target weights with a ceiling on repetitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import WORD, carried, opened, text_of, written

#: Mixing plans are configuration: one row per source on the driver, refused beyond this many.
MAX_SOURCES = 100_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def water_fill(caps: Sequence[float], weights: Sequence[float], total: float) -> list[float]:
    """Shares of `total` by weight; a share above its cap is clamped there and the excess goes to the others by weight, until none is above."""
    clamped = [False] * len(caps)
    level = 0.0
    while not all(clamped):
        level = (total - sum(c for c, done in zip(caps, clamped) if done)) / sum(w for w, done in zip(weights, clamped) if not done)
        over = [not done and w * level > c for c, w, done in zip(caps, weights, clamped)]
        if not any(over):
            break
        clamped = [done or now for done, now in zip(clamped, over)]
    return [float(c) if done else w * level for c, w, done in zip(caps, weights, clamped)]


def _draw(seed: int) -> Column:
    """48 seeded bits of a document's id and text: only rows equal in both share them."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of())))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _bucket(draw: Column, buckets: Column) -> Column:
    return F.floor(draw / F.lit(float(1 << 48)) * buckets).cast("long")


_PLAN = "s int, name string, source_size long, target double, whole int, rest double, buckets int"


def mix_sources(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: Sequence[int] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    Sources in code-point order (null last) weigh `weights` in turn and share `share` of all words by water-filling, each at
    most `max_epochs` times its own words. A source is repeated whole as often as its target allows; the rest is filled in
    seeded order by every document that still fits, through the whole source. For that the order is cut into about sqrt(n)
    ranges of a hash per source. In rounds, ranges whose documents all fit are settled by their sums, the next range is
    walked in a stream, and what stays open goes on behind it with the documents that are small enough. So no task holds a
    source, and what stays open in the end is less than the smallest document of words left out.

    Returns the input's columns and size, source_size, target (its source's), taken (words, repeats counted), repeats (at most
    `max_epochs`). Null text: size 0. Null source: a source of its own, last. Null doc_id: drawn by its text. Rows of one
    doc_id and text share a draw; repeated rows are taken one by one. Documents of size 0: repeated with the whole source
    only. A source of size 0: target 0. Empty table: empty result. Result names that clash with input columns replace them.
    Over `MAX_SOURCES` sources: ValueError.
    """
    narrow = written(docs.select("source", word_count().alias("size"), _draw(seed).alias("draw")), "sizes")
    found = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = water_fill([max_epochs * r.source_size for r in found], [weights[i % len(weights)] for i in range(len(found))], share * sum(r.source_size for r in found))
    plan = []
    for i, (r, target) in enumerate(zip(found, targets)):
        whole = int(target // r.source_size) if r.source_size else 0
        plan.append((i, r.source, r.source_size, target, whole, target - whole * r.source_size if whole < max_epochs else 0.0, max(1, round(r.n**0.5))))
    spark = docs.sparkSession
    planned = spark.createDataFrame(plan, _PLAN)
    named = narrow.join(F.broadcast(planned.select("s", "name", "buckets")), narrow["source"].eqNullSafe(planned["name"]))
    rules = _fill_plan(written(named.filter("size > 0").select("s", "size", "draw", _bucket(F.col("draw"), F.col("buckets")).alias("bucket")), "ranges"), plan)
    kind = "s int, settled array<struct<low:bigint,high:bigint,limit:double>>, walked map<bigint,double>"
    ruled = planned.join(F.broadcast(spark.createDataFrame([(s, *rules[s]) for s in sorted(rules)], kind)), "s")

    rows = carried(docs, source=F.col("source"), size=word_count(), draw=_draw(seed))
    rows = rows.join(F.broadcast(ruled), rows["source"].eqNullSafe(ruled["name"])).withColumn("bucket", _bucket(F.col("draw"), F.col("buckets")))
    rows = rows.withColumn("open", F.when(F.col("size") > 0, F.element_at("walked", F.col("bucket"))))
    fits = F.exists("settled", lambda r: (F.col("bucket") > r["low"]) & (F.col("bucket") < r["high"]) & (F.col("size") <= r["limit"]))
    clear = rows.filter(F.col("open").isNull()).withColumn("extra", ((F.col("size") > 0) & fits).cast("int")).drop("settled", "walked")
    walked = rows.filter(F.col("open").isNotNull()).drop("settled", "walked").repartition("s", "bucket").sortWithinPartitions("s", "bucket", "draw", "size")
    edge = walked.mapInArrow(_fill, T.StructType([*walked.schema.fields, T.StructField("extra", T.IntegerType())]))
    repeats = F.col("whole") + F.col("extra")
    return opened(clear.unionByName(edge), docs.columns, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), taken=F.col("size") * repeats, repeats=repeats)


def _fill_plan(ranged: DataFrame, plan: list[tuple]) -> dict[int, tuple[list[tuple[int, int, float]], dict[int, float]]]:
    """Per source the settled stretches (ranges between two bounds, whose documents up to a limit are all taken) and the walked
    ranges with what is open where each begins. One entry per source and round reaches the driver."""
    spark = ranged.sparkSession
    rules: dict[int, tuple[list, dict]] = {p[0]: ([], {}) for p in plan}
    state = {p[0]: (p[5], -1) for p in plan if p[5] >= 1}  # what is open, and the last range walked
    while state:
        now = F.broadcast(spark.createDataFrame([(s, left, last) for s, (left, last) in sorted(state.items())], "s int, open double, last long"))
        small = ranged.join(now, "s").filter((F.col("bucket") > F.col("last")) & (F.col("size") <= F.col("open")))
        sums = small.groupBy("s", "bucket", "open").agg(F.sum("size").alias("words"))
        running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("bucket")))
        crossed = F.when(F.col("upto") > F.col("open"), F.struct("bucket", (F.col("open") - (F.col("upto") - F.col("words"))).alias("open")))
        ends = {r.s: r.end for r in running.groupBy("s").agg(F.min(crossed).alias("end")).collect()}
        after = {}
        for s, (left, last) in state.items():
            end = ends.get(s)
            if s in ends:
                rules[s][0].append((last, end["bucket"] if end else 1 << 62, left))
            if end:
                rules[s][1][end["bucket"]] = after[s] = float(end["open"])
        if after:
            walks = F.broadcast(spark.createDataFrame([(s, ends[s]["bucket"], left) for s, left in sorted(after.items())], "s int, bucket long, open double"))
            edge = ranged.join(walks, ["s", "bucket"]).repartition("s").sortWithinPartitions("s", "bucket", "draw", "size")
            taken = edge.mapInArrow(_fill, T.StructType([*edge.schema.fields, T.StructField("extra", T.IntegerType())])).groupBy("s").agg(F.sum(F.col("size") * F.col("extra")).alias("words"))
            words = {r.s: r.words for r in taken.collect()}
            after = {s: left - words.get(s, 0) for s, left in after.items()}
        state = {s: (left, ends[s]["bucket"]) for s, left in after.items() if left >= 1}
    return rules


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the order given, take every row of a range that still fits what is open there."""
    at, left = None, 0.0
    for batch in batches:
        extra = []
        for s, bucket, size, start in zip(*[batch.column(c).to_pylist() for c in ("s", "bucket", "size", "open")]):
            if (s, bucket) != at:
                at, left = (s, bucket), start
            take = size <= left
            left -= size * take
            extra.append(int(take))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(extra, pa.int32())], [*batch.schema.names, "extra"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as `mix_sources` takes it, columns of the input; all its cases hold here.

    Null texts and texts without words stay only with sources repeated whole. Repeated rows: each as often as it is taken.
    Empty table: empty result. Columns of any other name go along unchanged.
    """
    taken = mix_sources(docs.select(F.struct("*").alias("whole_row"), "doc_id", "source", "text"), **options)
    return taken.filter(F.col("repeats") > 0).select("whole_row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")).select("whole_row.*")
