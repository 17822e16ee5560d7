"""Exact top-k search by inner product over metric trees (M-trees)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import written

#: Products of whole numbers are exact in double precision below this sum.
EXACT = float(1 << 53)


def integer_vector(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null where the vector is null or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros to `dim`."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    if len(flat):
        out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; Python's own numbers where doubles could round."""
    if len(rows) and np.abs(rows).max(initial=0) * np.abs(query).sum() >= EXACT:
        limit = (1 << 63) - 1
        q = [int(x) for x in query]
        return np.array([max(-limit - 1, min(limit, sum(int(a) * b for a, b in zip(r, q)))) for r in rows], dtype=np.int64)
    return np.rint(rows @ query).astype(np.int64)


class Tree:
    """An M-tree in pages.

    Every vector x gets one more coordinate sqrt(top - |x|^2), every query a zero there: the nearest vectors are then those of
    the largest inner product, by a true metric. An inner page holds routing vectors, each with the covering radius of its
    subtree and its distance to the routing vector of the page; a leaf page holds vectors with the same stored distance.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top: float, leaf: int = 128, fan: int = 32):
        self.ids, self.rows, self.top, self.leaf, self.fan = ids, rows, top, leaf, fan
        extra = np.sqrt(np.maximum(0.0, top - (rows * rows).sum(axis=1)))
        self.points = np.concatenate([rows, extra[:, None]], axis=1)
        self.rng = np.random.default_rng(len(ids))
        self.pages: list[tuple] = []
        everything = np.arange(len(ids))
        self.centre = self.points.mean(axis=0) if len(ids) else np.zeros(rows.shape[1] + 1)
        self.root = self._page(everything, self.centre)

    def _page(self, members: np.ndarray, parent: np.ndarray) -> int:
        if len(members) <= self.leaf:
            self.pages.append((True, members, np.linalg.norm(self.points[members] - parent, axis=1)))
            return len(self.pages) - 1
        fan = min(self.fan, -(-len(members) // self.leaf))
        routers = self.points[self.rng.choice(members, fan, replace=False)]
        points = self.points[members]
        squares = (points * points).sum(axis=1)[:, None] - 2 * points @ routers.T + (routers * routers).sum(axis=1)
        nearest = squares.argmin(axis=1)
        if (nearest == nearest[0]).all():  # copies: no router parts them, so they are cut by number
            nearest = np.arange(len(members)) * fan // len(members)
        kept, radius, children = [], [], []
        for i in range(fan):
            own = members[nearest == i]
            if len(own):
                kept.append(routers[i])
                radius.append(np.linalg.norm(self.points[own] - routers[i], axis=1).max())
                children.append(self._page(own, routers[i]))
        routing = np.array(kept)
        self.pages.append((False, routing, np.linalg.norm(routing - parent, axis=1), np.array(radius), children))
        return len(self.pages) - 1

    def search(self, query_id: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, vec_id) but the query's own id; ties to smaller ids; scores under `least` may be missing.

        Best first: pages wait in order of the least distance that their covering radius allows, until none can beat the
        k-th best. A stored distance to the page's routing vector rules entries out before their own distance is computed.
        """
        point = np.append(query, 0.0)
        square = float(query @ query)
        best: list[tuple[int, int]] = []

        def reach(score: int | None) -> float:
            return np.inf if score is None else np.sqrt(max(0.0, square + self.top - 2.0 * score)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(self.top))

        bound = reach(least)
        waiting = [(0.0, 0, self.root, float(np.linalg.norm(point - self.centre)))]
        count = 0
        while waiting:
            low, _, page, to_parent = heapq.heappop(waiting)
            if low > bound:
                break
            entry = self.pages[page]
            if entry[0]:
                members = entry[1][np.abs(entry[2] - to_parent) <= bound]
                scores = _scores(self.rows[members], query)
                ids = self.ids[members]
                fit = ids != query_id
                if len(best) == k:
                    fit &= scores >= best[-1][0]
                elif least is not None:
                    fit &= scores >= least
                if fit.any():
                    best = sorted([*best, *zip(scores[fit].tolist(), ids[fit].tolist())], key=lambda b: (-b[0], b[1]))[:k]
                    if len(best) == k:
                        bound = min(bound, reach(best[-1][0]))
                continue
            _, routing, stored, radius, children = entry
            at = np.nonzero(np.abs(stored - to_parent) - radius <= bound)[0]
            distance = np.linalg.norm(routing[at] - point, axis=1)
            for i, d in zip(at.tolist(), distance.tolist()):
                nearest = max(0.0, d - radius[i], low)
                if nearest <= bound:
                    count += 1
                    heapq.heappush(waiting, (nearest, count, children[i], d))
        return best


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, page: int = 4096, max_pivots: int = 256, block: int = 50_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of every query; both inputs are (vec_id, v array<long>).

    The top of the tree is a bounded sample of at most `max_pivots` vectors (the first by a hash); every vector belongs to its
    nearest pivot, whose covering radius is taken over all of them. A pivot's vectors are dealt into pages of about `page` by
    a hash, so many copies of one vector or one crowded pivot are many pages. Each query skips the pivots that triangle bounds
    rule out, against its k-th best score among the pivots themselves. In every page an M-tree of the page's vectors is
    searched best first. Queries come in blocks of about `block`, streamed past the tree. Nothing is approximate.

    A null vec_id or null vector takes no part. A row with a query's vec_id is the query's own. Repeated vectors rows count as
    rows each, repeated queries once. Ties go to the smaller vec_id. Vectors of different lengths are filled up with zeros.
    Fewer than k candidates: all of them. Empty tables: empty result. Scores beyond a long stop at its ends.
    """
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("v").cast("array<bigint>").alias("v")).filter("id is not null and v is not null"), "vectors")
    asked = queries.select(F.col("vec_id").cast("long").alias("id"), F.col("v").cast("array<bigint>").alias("v")).filter("id is not null and v is not null").distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top")).first()
    n_asked, dim_asked = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, dim, top = size.n, max(size.dim or 0, dim_asked or 0), size.top or 0.0
    wanted = max(1, min(max_pivots, n // page))
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(wanted).collect()
    pivot_ids = np.array([r.id for r in sample], np.int64)
    pivot_rows = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        pivot_rows[i, :len(r.v)] = r.v
    pivots = np.concatenate([pivot_rows, np.sqrt(np.maximum(0.0, top - (pivot_rows**2).sum(axis=1)))[:, None]], axis=1)

    def to_pivots(points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (points**2).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(axis=1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            distance = to_pivots(np.concatenate([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(axis=1)))[:, None]], axis=1))
            cell = distance.argmin(axis=1) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(distance[np.arange(len(v)), cell])], ["id", "v", "cell", "away"])

    placed = written(rows.mapInArrow(assign, "id long, v array<bigint>, cell int, away double"), "placed")
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    pages = [-(-cells[c].n // page) if c in cells else 0 for c in range(len(sample))]
    radius = np.array([cells[c].radius if c in cells else 0.0 for c in range(len(sample))])
    slack = 1e-6 * (1 + np.sqrt(top))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            distance = to_pivots(np.concatenate([v, np.zeros((len(v), 1))], axis=1))
            take, cell, least = [], [], []
            for i in range(len(v)):
                known = np.sort(_scores(pivot_rows[pivot_ids != ids[i]], v[i]))
                floor = int(known[-k]) if len(known) >= k else None
                bound = np.inf if floor is None else np.sqrt(max(0.0, float(v[i] @ v[i]) + top - 2.0 * floor))
                visit = np.nonzero(distance[i] - radius <= bound * (1 + 1e-9) + slack)[0]
                take += [i] * len(visit)
                cell += visit.tolist()
                least += [floor] * len(visit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), batch.column(1).take(pa.array(take, pa.int64())), pa.array(cell, pa.int32()), pa.array(least, pa.int64())], ["id", "v", "cell", "least"])

    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, -(-n_asked // block))
    count = F.get(F.array(*[F.lit(p) for p in pages]), F.col("cell"))
    seekers = asked.mapInArrow(route, "id long, v array<bigint>, cell int, least long").select(
        "cell", F.explode(F.sequence(F.lit(0), count - 1)).alias("page"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("seeks"), "id", "v", "least")
    members = placed.select(
        "cell", F.pmod(F.xxhash64(F.lit(3), "id"), count).cast("int").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("seeks"), "id", "v", F.lit(None).cast("long").alias("least"))
    dealt = members.unionByName(seekers).repartition("cell", "page", "block").sortWithinPartitions("cell", "page", "block", "seeks", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, ids, parts = None, None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "page", "block"))))
            seeks, own, least = batch.column("seeks").to_numpy(), batch.column("id").to_numpy(), batch.column("least").to_pylist()
            v = _matrix(batch.column("v"), dim)
            out: list[tuple[int, int, int]] = []
            for i, key in enumerate(keys):
                if key != at:
                    at, tree, ids, parts = key, None, [], []
                if not seeks[i]:
                    ids.append(own[i])
                    parts.append(v[i])
                    continue
                if tree is None:
                    tree = Tree(np.array(ids, np.int64), np.array(parts).reshape(len(ids), dim), top)
                out += [(int(own[i]), vec_id, score) for score, vec_id in tree.search(int(own[i]), v[i], k, least[i])]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    hits = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
