"""Extremely randomised trees grown level by level from grouped sums, all trees of all forests together.

A node draws its inputs and thresholds from a seeded hash of its tree and path, so any engine, task or retry grows the same
trees. Large nodes are split by sums over all rows, one pass a level; a node that fits one task is finished there, with its
whole subtree. Trees are tables of nodes: there is no bound on depth.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a node that one task finishes with its subtree.
LOCAL_ROWS = 20_000
#: Nodes that scoring holds in a task; of more, rows meet the subtrees they reach.
MODEL_NODES = 200_000

NODES = "forest int, tree int, path string, n long, positives long, input int, threshold double, score double"
ROOT = ""


@dataclass(frozen=True)
class ForestSpec:
    """One forest: the training set it grows on, its size, its limits and its class weights."""

    forest: int
    members: int
    trees: int
    inputs: int
    max_depth: int | None
    min_split: int
    min_leaf: int
    zero: float
    one: float


def inputs_tried(setting: str | float, width: int) -> int:
    """How many inputs a node tries."""
    if setting == "sqrt":
        return max(1, int(math.sqrt(width)))
    if setting == "log2":
        return max(1, int(math.log2(width)))
    return max(1, int(float(setting) * width))


def class_weights(setting: str, n: int, positives: int) -> tuple[float, float]:
    """Weights of class 0 and 1: `balanced` (n / (2 * class size)), or `a:b`."""
    if setting == "balanced":
        return (n / (2.0 * (n - positives)) if n > positives else 1.0), (n / (2.0 * positives) if positives else 1.0)
    zero, one = (float(v) for v in setting.split(":"))
    return zero, one


def forest_spec(forest: int, members: int, params: dict, width: int, n: int, positives: int) -> ForestSpec:
    """A spec from the parameters of the search grid; the defaults are those of the study."""
    zero, one = class_weights(params.get("class_weight", "balanced"), n, positives)
    return ForestSpec(
        forest, members, params.get("n_estimators", 800), inputs_tried(params.get("max_features", "sqrt"), width), params.get("max_depth"),
        params.get("min_samples_split", 6), params.get("min_samples_leaf", 2), zero, one,
    )


# ---- one node, in a task ----

def node_draws(seed: int, tree: int, path: str, width: int) -> tuple[list[int], list[float]]:
    """The order in which a node tries its inputs, and each input's place of the threshold between its ends."""
    digests = [hashlib.md5(f"{seed}|{tree}|{path}|{i}".encode()).hexdigest() for i in range(width)]
    return sorted(range(width), key=lambda i: (digests[i][:8], i)), [int(d[8:20], 16) / 2.0**48 for d in digests]


def _purity(n: float, positives: float, spec: ForestSpec) -> float:
    """Sum of squared class weights over their sum: what a split should make large on both sides."""
    a, b = (n - positives) * spec.zero, positives * spec.one
    return (a * a + b * b) / (a + b)


def _score(n: int, positives: int, spec: ForestSpec) -> float:
    a, b = (n - positives) * spec.zero, positives * spec.one
    return b / (a + b)


def may_split(n: int, positives: int, depth: int, spec: ForestSpec) -> bool:
    return 0 < positives < n and n >= spec.min_split and n >= 2 * spec.min_leaf and (spec.max_depth is None or depth < spec.max_depth)


def grow_subtree(x: np.ndarray, y: np.ndarray, tree: int, path: str, spec: ForestSpec, seed: int) -> list[tuple]:
    """All nodes below and with `path` over the rows of a node, as rows of `NODES`."""
    out, waiting = [], [(path, np.arange(len(y)))]
    while waiting:
        path, rows = waiting.pop()
        here, label = x[rows], y[rows]
        n, positives = len(rows), int(label.sum())
        best = None
        if may_split(n, positives, len(path), spec):
            order, place = node_draws(seed, tree, path, x.shape[1])
            low, high = here.min(axis=0), here.max(axis=0)
            tried = [i for i in order[: spec.inputs] if low[i] < high[i]] or [i for i in order if low[i] < high[i]][:1]
            for i in tried:
                threshold = low[i] + place[i] * (high[i] - low[i])
                threshold = low[i] if threshold >= high[i] else threshold
                left = here[:, i] <= threshold
                a, p = int(left.sum()), int(label[left].sum())
                if min(a, n - a) < spec.min_leaf:
                    continue
                gain = _purity(a, p, spec) + _purity(n - a, positives - p, spec)
                if best is None or gain > best[0]:
                    best = (gain, i, float(threshold), left)
        score = _score(n, positives, spec)
        if best is None:
            out.append((spec.forest, tree, path, n, positives, None, None, score))
        else:
            out.append((spec.forest, tree, path, n, positives, int(best[1]), best[2], score))
            waiting += [(path + "1", rows[~best[3]]), (path + "0", rows[best[3]])]
    return out


# ---- levels, over packed rows ----

#: Rows that a task packs together, and (tree, row) pairs of one task that finishes subtrees.
PACK_ROWS = 200_000
FINISH_ROWS = 200_000


@dataclass
class _Top:
    """Upper part of one tree: its nodes by number (root 0), each with its input (-1: none), threshold and children."""

    paths: list[str]
    input: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]

    @staticmethod
    def planted() -> "_Top":
        return _Top([ROOT], [-1], [0.0], [-1], [-1])

    def split(self, node: int, input: int, threshold: float) -> tuple[int, int]:
        first = len(self.paths)
        self.input[node], self.threshold[node], self.left[node], self.right[node] = input, threshold, first, first + 1
        for side in "01":
            self.paths.append(self.paths[node] + side)
            for column, value in ((self.input, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1)):
                column.append(value)
        return first, first + 1

    def reached(self, x: np.ndarray) -> np.ndarray:
        """The lowest node of this part on every row's way."""
        input, threshold, left, right = np.array(self.input), np.array(self.threshold), np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if input[0] >= 0 else np.arange(0)
        while len(live):
            node = at[live]
            at[live] = np.where(x[live, input[node]] <= threshold[node], left[node], right[node])
            live = live[input[at[live]] >= 0]
        return at


def _shared(rows: DataFrame, value: object) -> Broadcast:
    """A broadcast that holds classes of this module by value."""
    return rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """The rows of every training set in blocks: members, and x with y behind it as one run of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list) -> pa.RecordBatch:
            members, table = np.concatenate([m for m, _ in held]), np.concatenate([t for _, t in held])
            order = np.argsort(members, kind="stable")
            values, starts = np.unique(members[order], return_index=True)
            data = [table[part].tobytes() for part in np.split(order, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(data, pa.binary())], ["members", "data"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            held.append((batch.column("members").to_numpy(zero_copy_only=False), np.column_stack([x, y])))
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return rows.select("members", "x", F.col("y").cast("int").alias("y")).mapInArrow(pack, "members int, data binary")


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for members, data in zip(batch.column("members").to_pylist(), batch.column("data")):
        yield members, np.frombuffer(data.as_buffer(), np.float64).reshape(-1, width + 1)


def _level_sums(chunks: DataFrame, width: int, owners: dict[int, list[tuple[int, int]]], tops: dict, trials: dict) -> dict[tuple, tuple]:
    """Rows, positives, least and largest inputs on each side of every cut tried, by (forest, tree, node, cut, side); one pass."""
    shared = _shared(chunks, (owners, tops, trials))
    lows, highs = [f"l{i}" for i in range(width)], [f"h{i}" for i in range(width)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, tops, trials = cloudpickle.loads(shared.value)
        keys, facts = [], []
        for batch in batches:
            for members, table in _blocks(batch, width):
                x, y = table[:, :width], table[:, width]
                for key in owners.get(members, ()):
                    cuts = trials.get(key)
                    if not cuts:
                        continue
                    at = tops[key].reached(x)
                    most = max(len(c) for c in cuts.values())
                    size = len(tops[key].paths)
                    input, threshold = np.full((size, most), -1), np.zeros((size, most))
                    for node, tried in cuts.items():
                        for c, (i, value) in enumerate(tried):
                            input[node, c], threshold[node, c] = i, value
                    for c in range(most):
                        rows = np.nonzero(input[at, c] >= 0)[0]
                        if not len(rows):
                            continue
                        node = at[rows]
                        side = (x[rows, input[node, c]] > threshold[node, c]).astype(np.int64)
                        place = 2 * node + side
                        order = np.argsort(place, kind="stable")
                        values, starts = np.unique(place[order], return_index=True)
                        here = x[rows[order]]
                        n = np.diff(np.append(starts, len(order)))
                        keys.append(np.column_stack([np.full(len(values), key[0]), np.full(len(values), key[1]), values // 2, np.full(len(values), c), values % 2]))
                        facts.append(np.column_stack([n, np.add.reduceat(y[rows[order]], starts), np.minimum.reduceat(here, starts), np.maximum.reduceat(here, starts)]))
        if keys:
            k, f = np.concatenate(keys), np.concatenate(facts)
            columns = [*[pa.array(k[:, i].astype(np.int32)) for i in range(5)], *[pa.array(f[:, i].astype(np.int64)) for i in range(2)], *[pa.array(f[:, i]) for i in range(2, 2 + 2 * width)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["forest", "tree", "node", "cut", "side", "n", "positives", *lows, *highs]
    kind = "forest int, tree int, node int, cut int, side int, n long, positives long, " + ", ".join(f"{c} double" for c in [*lows, *highs])
    sums = chunks.mapInArrow(part, kind).groupBy(*names[:5]).agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
    out = {tuple(r[:5]): (r["n"], r["positives"], [r[c] for c in lows], [r[c] for c in highs]) for r in sums.collect()}
    shared.unpersist()
    return out


def _tried(seed: int, tree: int, path: str, facts: tuple, spec: ForestSpec) -> list[tuple[int, float]]:
    """The cuts a node tries, in their order: none where it may not split. Mirrors `grow_subtree`."""
    n, positives, low, high = facts
    if not may_split(n, positives, len(path), spec):
        return []
    order, place = node_draws(seed, tree, path, len(low))
    tried = [i for i in order[: spec.inputs] if low[i] < high[i]] or [i for i in order if low[i] < high[i]][:1]
    at = [low[i] + place[i] * (high[i] - low[i]) for i in tried]
    return [(i, low[i] if t >= high[i] else t) for i, t in zip(tried, at)]


def _finished(chunks: DataFrame, width: int, owners: dict, tops: dict, small: dict[tuple, dict[int, int]], blocks: list[tuple], specs: dict[int, ForestSpec], seed: int, pairs: int) -> DataFrame:
    """The subtrees of nodes that fit one task: the rows of a node meet once, packed, and its task grows all below it."""
    shared, named = _shared(chunks, (owners, tops, small)), chunks.sparkSession.sparkContext.broadcast(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, tops, small = cloudpickle.loads(shared.value)
        for batch in batches:
            for members, table in _blocks(batch, width):
                for key in owners.get(members, ()):
                    numbers = small.get(key)
                    if not numbers:
                        continue
                    of = np.full(len(tops[key].paths), -1)
                    of[list(numbers)] = list(numbers.values())
                    block = of[tops[key].reached(table[:, :width])]
                    rows = np.nonzero(block >= 0)[0]
                    if not len(rows):
                        continue
                    order = rows[np.argsort(block[rows], kind="stable")]
                    values, starts = np.unique(block[order], return_index=True)
                    data = [table[part].tobytes() for part in np.split(order, starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(data, pa.binary())], ["block", "data"])

    columns = [f.split()[0] for f in NODES.split(", ")]

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        forest, tree, path = named.value[int(key[0])]
        table = np.concatenate([np.frombuffer(d, np.float64) for d in group["data"]]).reshape(-1, width + 1)
        nodes = grow_subtree(np.ascontiguousarray(table[:, :width]), table[:, width].astype(np.int64), tree, path, specs[forest], seed)
        return pd.DataFrame(nodes, columns=columns).astype({"input": "Int32"})

    dealt = chunks.mapInArrow(deal, "block int, data binary").repartition(max(1, min(len(blocks), -(-pairs // FINISH_ROWS))), "block")
    return cut_lineage(dealt.groupBy("block").applyInPandas(finish, NODES))


def grow_forests(rows: DataFrame, specs: list[ForestSpec], *, seed: int = 42, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Nodes of all forests: rows of `NODES`, paths as texts of 0 (left, at most the threshold) and 1; leaves have no input.

    `rows` has members (the training set a row belongs to), x (array of doubles without nulls) and y (0 or 1). Rows are packed
    once; every level is one pass over them, whatever the number of trees: tasks lead rows through the nodes known so far and
    add up both sides of every cut tried in a node of more than `local_rows` rows. The driver holds those large nodes only, at
    most rows / `local_rows` a level and tree. Then the rows of every smaller node move once, to the task that finishes its
    subtree. A node tries the first inputs of its hashed order, those without spread left out (if none has spread, the first
    further one that has), at a threshold drawn between the ends of the node's values, and takes the cut of the least weighted
    Gini impurity that leaves enough rows on both sides; equal cuts: the first in that order.
    """
    if not specs:
        raise ValueError("no forest to grow")
    spark = rows.sparkSession
    by_forest = {s.forest: s for s in specs}
    width = len(rows.select("x").first()["x"])
    chunks = cut_lineage(_packed(rows.join(F.broadcast(spark.createDataFrame(sorted({(s.members,) for s in specs}), "members int")), "members"), width))
    whole = _set_facts(chunks, width)
    keys = [(s.forest, t) for s in specs if s.members in whole for t in range(s.trees)]
    owners: dict[int, list[tuple[int, int]]] = {}
    for key in keys:
        owners.setdefault(by_forest[key[0]].members, []).append(key)
    tops = {key: _Top.planted() for key in keys}
    waiting = [(key, 0, whole[by_forest[key[0]].members]) for key in keys]
    done, small, blocks, pairs = [], {}, [], 0
    while waiting:
        trials, large = {}, []
        for key, node, facts in waiting:
            spec, path = by_forest[key[0]], tops[key].paths[node]
            if facts[0] <= local_rows:
                small.setdefault(key, {})[node] = len(blocks)
                blocks.append((*key, path))
                pairs += facts[0]
                continue
            cuts = _tried(seed, key[1], path, facts, spec)
            large.append((key, node, facts, cuts))
            if cuts:
                trials.setdefault(key, {})[node] = cuts
        sums = _level_sums(chunks, width, owners, tops, trials) if trials else {}
        waiting = []
        for key, node, (n, positives, _, _), cuts in large:
            spec, best = by_forest[key[0]], None
            for c, (i, threshold) in enumerate(cuts):
                left, right = (sums.get((*key, node, c, side)) for side in (0, 1))
                if left is None or right is None or min(left[0], right[0]) < spec.min_leaf:
                    continue
                gain = _purity(left[0], left[1], spec) + _purity(right[0], right[1], spec)
                if best is None or gain > best[0]:
                    best = (gain, i, float(threshold), left, right)
            fact = (*key, tops[key].paths[node], n, positives)
            done.append((*fact, *(best[1:3] if best else (None, None)), _score(n, positives, spec)))
            if best:
                children = tops[key].split(node, *best[1:3])
                waiting += [(key, child, facts) for child, facts in zip(children, best[3:])]
    parts = [spark.createDataFrame(done, NODES)] if done else []
    if blocks:
        parts.append(_finished(chunks, width, owners, tops, small, blocks, by_forest, seed, pairs))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _set_facts(chunks: DataFrame, width: int) -> dict[int, tuple]:
    """Rows, positives, least and largest inputs of every training set."""
    names = ["members", "n", "positives", *[f"{e}{i}" for e in "lh" for i in range(width)]]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, len(t), int(t[:, width].sum()), *t[:, :width].min(axis=0).tolist(), *t[:, :width].max(axis=0).tolist()) for m, t in _blocks(batch, width)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if not i else pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(zip(*rows))], names)

    kind = "members int, n long, positives long, " + ", ".join(f"{c} double" for c in names[3:])
    facts = chunks.mapInArrow(part, kind).groupBy("members").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), *[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in names[3:]])
    return {r["members"]: (r["n"], r["positives"], list(r[3:3 + width]), list(r[3 + width:])) for r in facts.collect()}


# ---- scores ----

@dataclass
class _Compiled:
    """Trees of one forest as arrays: children of a node, its input, threshold and score; `roots` of the trees."""

    roots: np.ndarray
    input: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    score: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaf scores; trees are added up in their order."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            live = every[self.input[at] >= 0]
            while len(live):
                node = at[live]
                at[live] = np.where(x[live, self.input[node]] <= self.threshold[node], self.left[node], self.right[node])
                live = live[self.input[at[live]] >= 0]
            total += self.score[at]
        return total / len(self.roots)


def _compiled(nodes: pd.DataFrame) -> dict[int, _Compiled]:
    out = {}
    for forest, part in nodes.groupby("forest"):
        part = part.sort_values(["tree", "path"], kind="stable")
        place = {k: i for i, k in enumerate(zip(part["tree"], part["path"]))}
        child = lambda side: np.array([place.get((t, p + side), -1) for t, p in place])
        out[int(forest)] = _Compiled(
            np.array([i for (_, p), i in place.items() if p == ROOT]), part["input"].fillna(-1).to_numpy(np.int32), part["threshold"].to_numpy(float),
            child("0"), child("1"), part["score"].to_numpy(float),
        )
    return out


def score_forests(rows: DataFrame, nodes: DataFrame, *, keep: list[str], model_nodes: int = MODEL_NODES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The columns `keep`, forest and score, one row for each entry of `forests` (array<int>) of a row with `x`.

    Up to `model_nodes` nodes travel to the tasks with the code; of more, only those above subtrees of `local_rows` training
    rows do, and rows meet the subtree they reach.
    """
    if nodes.count() > model_nodes:
        return _score_by_subtrees(rows, nodes, keep, local_rows)
    forests = _compiled(nodes.select("forest", "tree", "path", "input", "threshold", "score").toPandas())
    shared = _shared(rows, forests)
    kind = T.StructType([*[rows.schema[c] for c in keep], T.StructField("forest", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = cloudpickle.loads(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            asked = batch.column("forests")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            wanted = asked.flatten().to_numpy(zero_copy_only=False)
            for forest in np.unique(wanted):
                at = owner[wanted == forest]
                part = batch.take(pa.array(at))
                score = forests[int(forest)].scores(x[at])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(np.full(len(at), forest, np.int32)), pa.array(score)], [*keep, "forest", "score"])

    return rows.select(*dict.fromkeys([*keep, "x", "forests"])).mapInArrow(scored, kind)


def _upper(nodes: DataFrame, local_rows: int) -> dict[tuple[int, int], _Top]:
    """The nodes of more than `local_rows` training rows, and under each its two children, as the upper part of every tree."""
    tops: dict[tuple[int, int], _Top] = {(r["forest"], r["tree"]): _Top.planted() for r in nodes.filter(F.col("path") == ROOT).select("forest", "tree").collect()}
    large = nodes.filter((F.col("n") > local_rows) & F.col("input").isNotNull()).select("forest", "tree", "path", "input", "threshold").collect()
    place = {(*key, ROOT): 0 for key in tops}
    for forest, tree, path, input, threshold in sorted(large, key=lambda r: (r["forest"], r["tree"], len(r["path"]))):
        left, right = tops[forest, tree].split(place[forest, tree, path], input, threshold)
        place[forest, tree, path + "0"], place[forest, tree, path + "1"] = left, right
    return tops


def _score_by_subtrees(rows: DataFrame, nodes: DataFrame, keep: list[str], local_rows: int) -> DataFrame:
    """Rows walk down the upper parts of their trees, which travel with the code, and meet the subtree below in its task."""
    # the columns kept are one struct, so none of them can take the place of the row's number
    marked = cut_lineage(rows.select(F.struct(*keep).alias("_kept"), "x", "forests", F.monotonically_increasing_id().alias("_row")))
    width = len(marked.select("x").first()["x"])
    tops = _upper(nodes, local_rows)
    trees_of: dict[int, list[int]] = {}
    for forest, tree in sorted(tops):
        trees_of.setdefault(forest, []).append(tree)
    shared = _shared(rows, (tops, trees_of))
    names = ["forest", "tree", "root"]

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, trees_of = cloudpickle.loads(shared.value)

        def packed(held: list) -> Iterator[pa.RecordBatch]:
            numbers, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            owner = np.concatenate([h[2] + first for h, first in zip(held, np.cumsum([0, *[len(h[0]) for h in held[:-1]]]))])
            wanted = np.concatenate([h[3] for h in held])
            for forest in np.unique(wanted):
                at = owner[wanted == forest]
                for tree in trees_of[int(forest)]:
                    top = tops[int(forest), tree]
                    reached = top.reached(x[at])
                    order = np.argsort(reached, kind="stable")
                    values, starts = np.unique(reached[order], return_index=True)
                    parts = [at[p] for p in np.split(order, starts[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(values), forest, np.int32)), pa.array(np.full(len(values), tree, np.int32)), pa.array([top.paths[v] for v in values]),
                        pa.array([numbers[p].tobytes() for p in parts], pa.binary()), pa.array([x[p].tobytes() for p in parts], pa.binary())], [*names, "rows", "data"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column("forests")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            held.append((batch.column("_row").to_numpy(), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), owner, asked.flatten().to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = {key: {p: i for i, p in zip(top.input, top.paths)} for key, top in cloudpickle.loads(shared.value)[0].items()}
        for batch in batches:
            roots = []
            for forest, tree, path in zip(*[batch.column(c).to_pylist() for c in ("forest", "tree", "path")]):
                known, end = upper[forest, tree], 0
                while end <= len(path) and known[path[:end]] >= 0:
                    end += 1
                roots.append(path[:end] if end <= len(path) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

    def leaves(held: pd.DataFrame, subtree: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame({"_row": [], "forest": [], "tree": [], "score": []}).astype({"_row": "int64", "forest": "int32", "tree": "int32"})
        forest, tree, root = (held[c].iloc[0] for c in names)
        own = subtree.assign(path=subtree["path"].str.slice(len(root)), tree=0, forest=0)
        (compiled,) = _compiled(own).values()
        score = compiled.scores(np.concatenate([np.frombuffer(d, np.float64) for d in held["data"]]).reshape(-1, width))
        return pd.DataFrame({"_row": np.concatenate([np.frombuffer(d, np.int64) for d in held["rows"]]), "forest": np.int32(forest), "tree": np.int32(tree), "score": score})

    met = marked.select("_row", "x", "forests").mapInArrow(led, "forest int, tree int, root string, rows binary, data binary")
    own = nodes.select("forest", "tree", "path", "input", "threshold", "score")
    below = own.mapInArrow(rooted, "forest int, tree int, path string, input int, threshold double, score double, root string").filter("root is not null")
    size = max(1, nodes.count() // 20_000, sum(len(t.paths) for t in tops.values()) // 16)
    pair = met.repartition(size, *names).groupBy(*names).cogroup(below.repartition(size, *names).groupBy(*names))
    found = pair.applyInPandas(leaves, "_row long, forest int, tree int, score double")
    # added up in the order of the trees, as where nodes travel whole
    listed = F.sort_array(F.collect_list(F.struct("tree", "score")))
    total = F.aggregate(listed, F.lit(0.0), lambda a, s: a + s["score"])
    means = found.groupBy("_row", "forest").agg((total / F.count("*")).alias("score"))
    return marked.select("_row", "_kept").join(means, "_row").select("_kept.*", "forest", "score")
