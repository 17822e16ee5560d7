"""Near-duplicate groups by exact Jaccard similarity of word shingles: fingerprints in BK-trees, then a prefix-filtered join, every candidate counted in full."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import LOWER_BYTES, carried, opened, written
from cohortflow.llm.simhash import BITS, SEED, components, near_links

#: Share of the documents (one in so many, and at least `SAMPLE` of them) whose shingles are counted to order all shingles; common:
#: in at least this many of them, the most frequent `MAX_COMMON` of these. They set the speed, not the result.
EVERY, SAMPLE, COMMON = 16, 5_000, 8
MAX_COMMON = 500_000
#: Longs of the parity bits of a set.
LONGS = 8
#: Differing bits up to which fingerprints of two sets are linked before the exact check; it sets the speed, not the result.
RADIUS = 4
#: Sets asked for at once whose text hashes are sent to all tasks, so that only texts asked for are shuffled; more meet the texts in a shuffle.
SENT = 500_000


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all word shingles; a text of fewer words is one shingle, a text without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not tokens:
        return np.empty(0, dtype=np.int64)
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[i:i + words]), SEED) for i in range(n)), dtype=np.uint64, count=n).view(np.int64))


def least_size(size: int) -> int:
    """The fewest shingles that a set of this size shares with one of similarity 0.8 or more."""
    return (4 * size + 4) // 5


def _key(found: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def parities(found: np.ndarray) -> np.ndarray:
    """Of 64 * LONGS classes of shingles, one bit each: whether the set holds an odd number. Two sets differ in no more bits than shingles."""
    odd = np.bincount(found & (64 * LONGS - 1), minlength=64 * LONGS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def majority(found: np.ndarray) -> int:
    """Similarity fingerprint of a set: each bit's majority over the hashes of its shingles, as a signed long; 0 for an empty set."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(found), 65_536):  # bounded memory for very long texts
        part = np.ascontiguousarray(found[start:start + 65_536]).astype("<i8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def _prefixes(text: Column, words: int, common: tuple[np.ndarray, np.ndarray]) -> Column:
    """Key, size, parity bits and fingerprint of a text's set, and its first shingles in one order for all texts: rare ones by hash, then common ones by rising count."""
    known, rank = common

    @F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("size", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("print", T.LongType())]))
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = shingles(t, words)
            n = len(found)
            first = n - least_size(n) + 1 if n else 0
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            often = known[at] == found if len(known) else np.zeros(n, bool)
            rare = found[~often]
            if len(rare) < first:
                rare = np.concatenate([rare, found[often][np.argsort(rank[at[often]], kind="stable")]])
            rows.append((_key(found), n, rare[:first], parities(found), majority(found)))
        return pd.DataFrame(rows, columns=["fp", "size", "prefix", "bits", "print"])

    return of(text)


def _sets(text: Column, words: int) -> Column:
    @F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]))
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(_key(found), found) for found in (shingles(t, words) for t in texts)]
        return pd.DataFrame(rows, columns=["fp", "shingles"])

    return of(text)


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample hold, sorted, and the rank of each by its count."""
    every = max(1, min(EVERY, docs.count() // SAMPLE))
    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(every)) == 0).select("text").distinct()
    counts = some.select(F.explode(_sets(F.col("text"), words)["shingles"]).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "w").limit(MAX_COMMON).toPandas()
    known, n = found["w"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, n))] = np.arange(len(known))
    order = np.argsort(known)
    return known[order], rank[order]


def _candidates(met: DataFrame, name: str) -> DataFrame:
    """Pairs a < b that may be similar and the count c of the places (a, na, b, nb) where they meet."""
    first = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    pairs = met.filter((F.col("a") != F.col("b")) & (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")))
    pairs = pairs.select(first("a", "b").alias("a"), first("b", "a").alias("b"), first("na", "nb").alias("na"), first("nb", "na").alias("nb"))
    counted = pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    behind = F.expr("(4 * greatest(na, nb) + 4) div 5 - 1")
    return written(counted.filter(9 * (F.col("c") + behind) >= 4 * (F.col("na") + F.col("nb"))), name)


def _rooted(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The rows with r<column>: the component of a set, itself where it has no link."""
    return rows.join(labels.select(F.col("v").alias(column), F.col("root").alias("_root")), column, "left").withColumn(f"r{column}", F.coalesce("_root", column)).drop("_root")


def _counted(pairs: DataFrame, docs: DataFrame, values: DataFrame, words: int) -> DataFrame:
    """Links (a, b): the pairs whose whole sets have a similarity of 0.8 or more."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(values.select("fp", "low_hash"), "fp").select(F.col("fp").alias("want"), "low_hash")
    asked = written(asked, "asked")
    if asked.count() <= SENT:
        asked = F.broadcast(asked)
    texts = docs.select("text", F.xxhash64("text").alias("row_hash")).join(asked, F.col("row_hash") == F.col("low_hash")).dropDuplicates(["want"])
    sets = written(texts.select(_sets(F.col("text"), words).alias("s")).select("s.*"), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    return written(both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "links")


def _proposed(values: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) that fingerprints propose: BK-trees find what at most `RADIUS` bits connect, and every set of such a group meets the
    group's smallest key, one pair a set."""
    prints = written(values.groupBy("print").agg(F.min("fp").alias("low")), "fingerprints")
    groups = components(near_links(prints.select(F.col("print").alias("fp")), prints.count(), RADIUS))
    named = values.select("print", "fp", "size").join(groups.withColumnRenamed("v", "print"), "print", "left").withColumn("group", F.coalesce("root", "print"))
    named = written(named.select("group", "fp", "size"), "named")
    heads = named.groupBy("group").agg(F.min(F.struct("fp", "size")).alias("h"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    pairs = named.join(heads, "group").select(F.col("h.fp").alias("a"), F.col("fp").alias("b"), F.col("h.size").alias("na"), F.col("size").alias("nb"))
    return written(pairs.filter((F.col("a") != F.col("b")) & (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))), "proposed")


def similar_links(docs: DataFrame, values: DataFrame, words: int = 5) -> DataFrame:
    """Links (a, b) between distinct sets of a Jaccard similarity of 0.8 or more, enough to connect all that such pairs connect;
    values: fp, size, prefix, bits, print, low_hash.
    Of n shingles in one global order, two such sets share one among the first n - ceil(0.8 n) + 1 of each; what many texts
    share comes last in that order, so texts around one passage do not meet by it. Pairs that meet
    there share at most the c places where they meet and what stands behind the prefix that ends first; a pair for which
    that is below 4/9 of both sizes (the same bound as 0.8) is dropped. All others are counted on their whole sets.

    Sets meet in three rounds, later ones only across the components that earlier ones leave. The representative of a shingle
    is the set of the smallest key that holds it. First every set is compared with the set that similarity fingerprints propose, or
    with one representative, the one it meets in most places: at most one pair a set, which joins a group of near copies. Then with the other representatives it meets. Last, sets
    are compared with each other where a shingle still has holders of different components; sets of such a similarity differ in
    at most a ninth of their sizes' sum, so a pair whose parity bits differ in more is never formed. So a group of copies is not
    expanded into its pairs, and no connection is lost.
    """
    proposed = _proposed(values)
    holders = Window.partitionBy("w").orderBy("fp")
    low = holders.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    posts = values.select(F.explode("prefix").alias("w"), "fp", "size").withColumns({"a": F.first("fp").over(low), "na": F.first("size").over(low), "next": F.lead("fp").over(holders)})
    shared = written(posts.filter((F.col("fp") != F.col("a")) | F.col("next").isNotNull()).drop("next"), "shared")
    met = _candidates(shared.select("a", "na", F.col("fp").alias("b"), F.col("size").alias("nb")), "met")
    best = met.groupBy("b", "nb").agg(F.max(F.struct("c", "a", "na")).alias("h")).select(F.col("h.a").alias("a"), "b", F.col("h.na").alias("na"), "nb")
    best = written(best.join(proposed.select("b"), "b", "left_anti").select("a", "b", "na", "nb").unionByName(proposed), "pairs")
    links = _counted(best, docs, values, words)
    labels = components(links)
    others = _rooted(_rooted(met.join(best.select("a", "b"), ["a", "b"], "left_anti"), labels, "a"), labels, "b").filter(F.col("ra") != F.col("rb"))
    links = links.unionByName(_counted(written(others.select("a", "b", "na", "nb"), "pairs"), docs, values, words))
    rooted = written(_rooted(shared.select("w", "fp", "size"), components(links), "fp").withColumnRenamed("rfp", "root"), "rooted")
    mixed = written(rooted.groupBy("w").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") < F.col("high")).select("w"), "mixed")
    open_posts = written(rooted.join(mixed, "w", "left_semi").join(values.select("fp", "bits"), "fp"), "open")
    a, b = (open_posts.select("w", F.col("fp").alias(x), F.col("size").alias(f"n{x}"), F.col("root").alias(f"r{x}"), F.col("bits").alias(f"p{x}")) for x in ("a", "b"))
    apart = sum((F.bit_count(F.get("pa", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    near = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * apart <= F.col("na") + F.col("nb"))
    met = a.join(b, "w").filter(near)
    return links.unionByName(_counted(_candidates(met, "pairs"), docs, values, words))


def _linked(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row per document, one per distinct set (with `first`: the row that stands for it), and the components of linked sets."""
    docs = docs.select("doc_id", "text")
    prints = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), _prefixes(F.col("text"), words, _common(docs, words)).alias("p"))
    prints = written(prints.select("doc_id", "row_hash", "p.*"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_hash")).alias("first")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.min("row_hash").alias("low_hash"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("print").alias("print"), first)
    values = written(values, "values")
    return prints, values, components(similar_links(docs, values, words))


def similar_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """Group of every document: doc_id, row_hash (of the text), component_id.

    Documents whose sets of word shingles (ASCII lower case; held as 64-bit hashes) have a Jaccard similarity of 0.8 or more are
    linked, all of them; component_id is the smallest doc_id that chains of links reach. Equal sets are one value from the start.

    Null, empty or white-space text: no shingles, equal to each other only. Fewer words than a shingle: the text is one. Null
    doc_id: never names a component; a component of null ids only has a null component_id. Repeated rows: one row each. Empty
    table: empty result. Very long texts: whole. Other columns are not read.
    """
    prints, values, labels = _linked(docs, words)
    linked = values.select("fp", "low_id").join(labels.withColumnRenamed("v", "fp"), "fp")
    low = written(linked.groupBy("root").agg(F.min("low_id").alias("component_id")), "low")
    of_linked = linked.join(low, "root").select("fp", "component_id")
    named = written(values.select("fp", "low_id").join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "low_id").alias("component_id")), "named")
    return prints.select("doc_id", "row_hash", "fp").join(named, "fp").select("doc_id", "row_hash", "component_id")


def drop_similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per group of `similar_groups`: of the smallest doc_id, and of its texts the one of the smallest hash. All columns of the input, unchanged.

    Null doc_id: such a row stays only where no row of its group has one, and then one of the group, the text of the smallest hash.
    Repeated rows of the kept doc_id and text: one stays.
    """
    _, values, labels = _linked(docs, words)
    linked = values.select("fp", "first").join(labels.withColumnRenamed("v", "fp"), "fp")
    low = written(linked.groupBy("root").agg(F.min("first").alias("first")).select("first"), "low")
    alone = values.select("fp", "first").join(labels.select(F.col("v").alias("fp")), "fp", "left_anti").select("first")
    keep = alone.unionByName(low).select(F.struct("first.doc_id", F.coalesce("first.row_hash", F.lit(0)).alias("row_hash")).alias("key"))
    # In a struct null equals null, and hashes are never null on either side: one shuffle of the rows does for both steps.
    rows = carried(docs, key=F.struct(F.col("doc_id"), F.xxhash64("text").alias("row_hash")))
    return opened(rows.join(keep, "key", "left_semi").dropDuplicates(["key"]), docs.columns)
