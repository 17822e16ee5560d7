"""Near-duplicate groups by 64-bit similarity fingerprints and trees over Hamming distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import LOWER_BYTES, carried, opened, written

SEED = 42
BITS = 64


# ---- fingerprints ----

def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit fingerprint: the majority of each bit over the hashes of all word shingles, repeats included; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, 65_536):  # bounded memory for very long texts
        stop = min(n, start + 65_536)
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[i:i + words]), SEED) for i in range(start, stop)), dtype="<u8", count=stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = 4) -> Column:
    """`fingerprint` of a text column as a signed long of the same bits."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


# ---- trees ----

class Forest:
    """BK-trees over the values of several groups, built and searched level by level on arrays.

    Every group has its own root. A child hangs below its parent at the integer Hamming distance between both; of the values at
    one distance from a node the first becomes the child and the rest go on below it.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        n = len(values)
        self.values = values
        ids, first, group_of = np.unique(groups, return_index=True, return_inverse=True)
        self.group_ids, self.roots = ids, first
        pending = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = first[group_of[pending]]
        keys, kids = [], []
        while len(pending):
            edge = at.astype(np.int64) * (BITS + 1) + np.bitwise_count(values[pending] ^ values[at])
            edges, head, slot = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(edges)
            kids.append(pending[head])
            rest = np.ones(len(pending), dtype=bool)
            rest[head] = False
            at, pending = pending[head][slot[rest]], pending[rest]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        kid = np.concatenate(kids) if kids else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.edge_key, self.edge_child = key[order], kid[order]

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices (query, value) of all pairs of one group within the radius; only edges that can lead to one are followed."""
        place = np.searchsorted(self.group_ids, groups)
        found = place < len(self.group_ids)
        found[found] = self.group_ids[place[found]] == groups[found]
        q = np.nonzero(found)[0]
        node = self.roots[place[q]]
        hits_q, hits_v = [], []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            hits_q.append(q[near])
            hits_v.append(node[near])
            base = node.astype(np.int64) * (BITS + 1)
            low = np.searchsorted(self.edge_key, base + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.edge_key, base + np.minimum(d + radius, BITS), "right")
            width = high - low
            total = int(width.sum())
            step = np.arange(total) - np.repeat(np.cumsum(width) - width, width)
            node = self.edge_child[np.repeat(low, width) + step]
            q = np.repeat(q, width)
        return (np.concatenate(hits_q), np.concatenate(hits_v)) if hits_q else (np.empty(0, np.int64), np.empty(0, np.int64))


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of linked members; every class is named by its smallest index."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def _links(values: np.ndarray, groups: np.ndarray, tree_side: np.ndarray, query_side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains of links that connect what the radius connects inside each group; at most one link per member."""
    tree_at, query_at = np.nonzero(tree_side)[0], np.nonzero(query_side)[0]
    forest = Forest(values[tree_at], groups[tree_at])
    labels = np.arange(len(values))
    start = 0
    sizes = np.bincount(np.searchsorted(forest.group_ids, groups[tree_at]), minlength=len(forest.group_ids))
    place = np.minimum(np.searchsorted(forest.group_ids, groups[query_at]), max(0, len(sizes) - 1))
    cost = np.cumsum(sizes[place]) if len(sizes) else np.zeros(len(query_at), np.int64)
    while start < len(query_at):  # as many queries at a time as keep the pairs under examination near a million
        done = cost[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(cost, done + 1_000_000, "right")))
        q, v = forest.search(values[query_at[start:stop]], groups[query_at[start:stop]], radius)
        labels = _join(labels, query_at[start + q], tree_at[v])
        start = stop
    order = np.argsort(labels, kind="stable")
    same = labels[order[1:]] == labels[order[:-1]]
    return values[order[:-1][same]], values[order[1:][same]]


# ---- links between distinct fingerprints ----

def key_plan(n: int, radius: int, shard: int = 1024) -> tuple[int, int]:
    """Blocks, and blocks that must agree: values within `radius` bits agree in at least blocks - radius of them.

    The fewest blocks for which a shard holds about `shard` of n evenly spread values; more blocks only make shards smaller.
    """
    for blocks in range(radius + 1, radius + 4):
        bits = (blocks - radius) * (BITS // blocks)
        if n <= shard << bits:
            break
    return blocks, blocks - radius


def shard_keys(value: Column, blocks: int, agree: int) -> Column:
    """All shards of a value: the number of a choice of blocks, with the bits in them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        mask = 0
        for i in chosen:
            mask |= ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        keys.append(F.struct(F.lit(number).alias("t"), value.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)).alias("k")))
    return F.array(*keys)


def near_links(values: DataFrame, n: int, radius: int, shard_limit: int = 4096) -> DataFrame:
    """Links (a, b) among distinct values `fp`, enough to connect all that chains of at most `radius` bits connect.

    Each shard of values that agree in enough bits gets its own BK-tree. A shard over `shard_limit` is cut into parts; every
    pair of parts is one piece of work, where the tree of the first meets the values of the second, so no task holds more
    than two parts and nothing is left out.
    """
    blocks, agree = key_plan(n, radius)
    keyed = values.select("fp", F.inline(shard_keys(F.col("fp"), blocks, agree)))
    large = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_limit)
    parts = keyed.join(large, ["t", "k"], "left").select("t", "k", "fp", F.coalesce(F.ceil(F.col("n") / shard_limit), F.lit(1)).cast("int").alias("m"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    work = parts.select("t", "k", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    work = work.select("t", "k", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "fp", (F.col("part") <= F.col("other")).alias("tree"), (F.col("part") >= F.col("other")).alias("ask"))
    spread = work.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _whole_groups(batches):
            key = np.stack([run[c] for c in ("t", "k", "a", "b")])
            change = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]) if key.shape[1] else np.empty(0, bool)
            left, right = _links(run["fp"].view(np.uint64), np.cumsum(change), run["tree"], run["ask"], radius)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["a", "b"])

    return spread.mapInArrow(search, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows sorted by (t, k, a, b) that end where a group ends."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def arrays(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(parts)
        return {c: table.column(c).to_numpy() for c in table.column_names}

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        run = arrays(held)
        last = np.ones(rows, dtype=bool)
        for c in ("t", "k", "a", "b"):
            last &= run[c] == run[c][-1]
        cut = rows - int(last.sum())
        if cut:
            yield {c: v[:cut] for c, v in run.items()}
            rest = pa.Table.from_batches(held).slice(cut).combine_chunks()
            held = rest.to_batches()
            rows = rest.num_rows
    if rows:
        yield arrays(held)


# ---- components ----

def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): every linked value `v` with the smallest value `root` it reaches.

    Rounds of hooking and shortening: the roots at both ends of a link are compared, each larger one hooks to the smallest it
    meets, and all pointers are shortened. A round is three shuffles of pointers and links; rounds grow with the logarithm of
    the longest chain. The hook table is written before it is joined, so Spark can split a root that a third of all rows
    point to.
    """
    links = links.filter(F.col("a") != F.col("b")).distinct()
    links = written(links, "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root"))
    labels = written(labels, "labels")
    while True:
        ends = links.join(labels.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(labels.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        apart = ends.filter(F.col("ra") != F.col("rb"))
        hooks = apart.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("up"))
        hooks = written(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # a hook may point to a root that is hooked itself
            further = hooks.select(F.col("root").alias("up"), F.col("up").alias("next"))
            longer = written(hooks.join(further, "up", "left").select("root", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = longer.select("root", "up")
            if longer.filter("moved").isEmpty():
                break
        labels = written(labels.join(hooks, "root", "left").select("v", F.coalesce("up", "root").alias("root")), "labels")


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and group of every document: doc_id, row_hash (of the text), fp (signed long), component_id.

    Fingerprints that differ in at most `radius` bits are linked; component_id is the smallest doc_id that chains of links
    reach. Equal fingerprints are one value from the start, so copies never meet each other as pairs.

    Null, empty or white-space text: fingerprint zero, linked like any other. Null doc_id: the row gets a fingerprint and a
    component; the id itself never names one, and a component of null ids only has a null component_id. Repeated rows: one row
    each. Empty table: empty result. Other columns are not read.
    """
    prints = written(docs.select("doc_id", F.xxhash64("text").alias("row_hash"), fingerprint_column(F.col("text"), words).alias("fp")), "prints")
    values = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "values")
    labels = components(near_links(values.select("fp"), values.count(), radius))
    linked = values.join(labels.withColumnRenamed("v", "fp"), "fp")
    low = written(linked.groupBy("root").agg(F.min("low_id").alias("component_id")), "low")
    of_linked = linked.join(low, "root").select("fp", "component_id")
    named = written(values.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "low_id").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "row_hash", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per group of `near_groups`: the one of the smallest doc_id. All columns of the input, unchanged.

    Rows of a group without any doc_id stay as they are, except exact repeats. Repeated rows of the kept doc_id: one stays.
    """
    keep = near_groups(docs, words, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("keep_id"), F.col("row_hash").alias("keep_hash")).distinct()
    rows = carried(docs, id=F.col("doc_id"), row_hash=F.xxhash64("text"))
    kept = rows.join(keep, rows["id"].eqNullSafe(keep["keep_id"]) & (rows["row_hash"] == keep["keep_hash"]), "left_semi")
    return opened(kept.dropDuplicates(["id", "row_hash"]), docs.columns)
