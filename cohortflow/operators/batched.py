"""Many penalised logistic fits at once: every pass over the rows adds up what all models need, whatever their number."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .preprocess import Preparation

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of sums that one pass carries; more models than that go in several passes.
PASS_BYTES = 64 << 20
#: Rows of one block of products.
BLOCK_ROWS = 2000


@dataclass(frozen=True)
class ModelSpec:
    """One model: the training set it is fitted on, its inputs and its penalty."""

    members: int
    inputs: tuple[str, ...]
    C: float
    l1_ratio: float


@dataclass
class Solution:
    """Coefficients of a model over all features (intercept first, zero for inputs it does not use), Newton steps, and whether they ended."""

    beta: np.ndarray
    iterations: int
    converged: bool


class Features:
    """How raw inputs become the standardised features of a training set: median fill, then indicators, then scaling."""

    def __init__(self, columns: list[str], preps: dict[int, Preparation], indicators: bool):
        self.columns, self.preps = list(columns), preps
        self.names = [*columns, *[f"missing_{c}" for c in columns]] if indicators else list(columns)
        self.median = {s: np.array([p.medians[c] for c in columns]) for s, p in preps.items()}
        self.mean = {s: np.array([p.means.get(n, 0.0) for n in self.names]) for s, p in preps.items()}
        self.scale = {s: np.array([p.scales.get(n, 1.0) for n in self.names]) for s, p in preps.items()}

    def used(self, spec: ModelSpec) -> np.ndarray:
        """Which features (intercept first) a model may use."""
        known = set(self.preps[spec.members].indicators)
        own = set(spec.inputs)
        return np.array([True, *[(n in own) if n in self.columns else (n.removeprefix("missing_") in own & known) for n in self.names]])

    def standardised(self, x: np.ndarray, members: int) -> np.ndarray:
        """Features with a leading one; x has NaN for gaps."""
        gap = np.isnan(x)
        filled = np.where(gap, self.median[members], x)
        wide = np.concatenate([filled, gap], axis=1) if len(self.names) > len(self.columns) else filled
        return np.concatenate([np.ones((len(x), 1)), (wide - self.mean[members]) / self.scale[members]], axis=1)


def _by_set(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """Sets listed in an array column, each with its rows."""
    lists = batch.column(column)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    members = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(members, kind="stable")
    values, starts = np.unique(members[order], return_index=True)
    for value, rows in zip(values, np.split(owner[order], starts[1:])):
        yield int(value), rows


def _inputs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def set_medians(rows: DataFrame, columns: list[str], sets: int, *, buckets: int = 1024) -> dict[int, dict[str, float | None]]:
    """Exact medians of every input in every training set (x and train as in `fit_models`), with no row repeated for its sets.

    Counts per set and value bucket show where the two middle ranks lie; only distinct values of those buckets are shuffled.
    """
    width = len(columns)
    size = max(16, min(buckets, (4 << 20) // max(1, sets * width)))
    flat = rows.select(*[F.get("x", F.lit(i)).alias(f"c{i}") for i in range(width)])
    found = flat.approxQuantile(flat.columns, [i / size for i in range(1, size)], 1 / (4 * size))
    bounds = [np.unique([b for b in q if np.isfinite(b)]) for q in found]

    def coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _inputs(batch)
        return x, np.column_stack([np.searchsorted(b, x[:, i], side="right") for i, b in enumerate(bounds)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x, code = coded(batch)
                place, present = code + size * np.arange(width), ~np.isnan(x)
                for members, at in _by_set(batch, "train"):
                    counts = np.bincount(place[at][present[at]], minlength=size * width)
                    total[members] = total[members] + counts if members in total else counts
        for members, counts in total.items():
            some = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), members, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], ["m", "b", "n"])

    held = rows.select("x", "train")
    table: dict[int, np.ndarray] = {}
    for m, b, n in held.mapInArrow(count, "m int, b int, n long").groupBy("m", "b").agg(F.sum("n").alias("n")).collect():
        table.setdefault(m, np.zeros((width, size), np.int64))[b // size, b % size] = n
    middle, wanted = [], {}
    for m, counts in table.items():
        for i in range(width):
            until = np.cumsum(counts[i])
            if until[-1]:
                low, high = (until[-1] - 1) // 2, until[-1] // 2
                first, last = (int(np.searchsorted(until, r, side="right")) for r in (low, high))
                before = int(until[first] - counts[i, first])
                wanted.setdefault(m, {})[i] = (first, last)
                middle.append((m, i, int(low) - before, int(high) - before))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = coded(batch)
            for members, at in _by_set(batch, "train"):
                for i, ends in wanted.get(members, {}).items():
                    here = x[at, i][np.isin(code[at, i], ends) & ~np.isnan(x[at, i])]
                    values, n = np.unique(here, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), members, np.int32)), pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(n.astype(np.int64))], ["m", "i", "v", "n"])

    out: dict[int, dict[str, float | None]] = {m: dict.fromkeys(columns) for m in table}
    if middle:
        values = held.mapInArrow(pick, "m int, i int, v double, n long").groupBy("m", "i", "v").agg(F.sum("n").alias("n"))
        until = F.sum("n").over(Window.partitionBy("m", "i").orderBy("v"))
        ranked = values.withColumn("until", until).join(F.broadcast(rows.sparkSession.createDataFrame(middle, "m int, i int, low long, high long")), ["m", "i"])
        at = lambda r: F.max(F.when((F.col("until") - F.col("n") <= F.col(r)) & (F.col(r) < F.col("until")), F.col("v")))
        for m, i, low, high in ranked.groupBy("m", "i").agg(at("low"), at("high")).collect():
            out[m][columns[i]] = low if low == high else 0.5 * low + 0.5 * high
    return out


def _sums(rows: DataFrame, features: Features, specs: list[ModelSpec], beta: np.ndarray, live: np.ndarray, share: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature of every live model at `beta`, by one pass over the rows."""
    p = beta.shape[1]
    own: dict[int, list[int]] = {}
    for m in np.nonzero(live)[0]:
        own.setdefault(specs[m].members, []).append(int(m))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros(1 + p + p * p) for ms in own.values() for m in ms}
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x, label = _inputs(batch), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            for members, rows in _by_set(batch, "train"):
                models = own.get(members)
                for start in range(0, len(rows) if models else 0, BLOCK_ROWS):
                    at = rows[start:start + BLOCK_ROWS]
                    z, y = features.standardised(x[at], members), label[at]
                    weight = np.where(y == 1, share[members][1], share[members][0])[:, None]
                    line = z @ beta[models].T
                    chance = 1 / (1 + np.exp(-np.clip(line, -35, 35)))
                    loss = (weight * (np.logaddexp(0, line) - y[:, None] * line)).sum(axis=0)
                    slope = (weight * (chance - y[:, None])).T @ z
                    bend = weight * chance * (1 - chance)
                    curve = np.stack([(bend * z[:, [j]]).T @ z for j in range(p)], axis=1)
                    for i, m in enumerate(models):
                        total[m] += np.concatenate([[loss[i]], slope[i], curve[i].ravel()])
        if seen:
            names = list(total)
            width = 1 + p + p * p
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * width, pa.int32()), pa.array(np.concatenate([total[m] for m in names])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), values], ["m", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for m, v in zip(batch.column("m").to_pylist(), flat):
                total[m] = total[m] + v if m in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["m", "v"])

    kind = "m int, v array<double>"
    summed = rows.select("label", "x", "train").mapInArrow(part, kind).repartition("m").mapInArrow(add, kind)
    return {r["m"]: np.array(r["v"]) for r in summed.collect()}


def _newton(beta: np.ndarray, slope: np.ndarray, curve: np.ndarray, l1: np.ndarray, l2: np.ndarray, used: np.ndarray, tol: float) -> np.ndarray:
    """The next coefficients of every model: the minimum of its quadratic model plus the penalty."""
    p = beta.shape[1]
    free = used.astype(float)
    free[:, 0] = 0.0
    slope = (slope + l2[:, None] * free * beta) * used
    curve = curve * used[:, :, None] * used[:, None, :]
    curve[:, np.arange(p), np.arange(p)] += l2[:, None] * free + np.where(used, 1e-12, 1.0)
    new = beta.copy()
    smooth = l1 == 0
    if smooth.any():
        new[smooth] -= np.linalg.solve(curve[smooth], slope[smooth][:, :, None])[:, :, 0]
    at = np.nonzero(~smooth)[0]
    if len(at):  # coordinate descent
        w, g, h, cost = new[at], slope[at].copy(), curve[at], l1[at]
        for _ in range(1000):
            before = w.copy()
            for j in range(p):
                bend = h[:, j, j]
                raw = w[:, j] - g[:, j] / bend
                value = np.where(used[at, j], raw if j == 0 else np.sign(raw) * np.maximum(np.abs(raw) - cost / bend, 0.0), 0.0)
                g += h[:, :, j] * (value - w[:, j])[:, None]
                w[:, j] = value
            if np.abs(w - before).max() < tol / 10:
                break
        new[at] = w
    return new


def fit_models(rows: DataFrame, features: Features, specs: list[ModelSpec], *, balanced: bool = False, max_iter: int = 100, tol: float = 1e-9) -> list[Solution]:
    """Every model's minimum of the weighted loss plus ((1 - l1_ratio)/2 |w|^2 + l1_ratio |w|) / C, the intercept free.

    `rows` has label (0 or 1), x (inputs, null for gaps) and train (the sets a row belongs to); it should be kept in memory.
    All models take Newton steps together: a step is one job, however many sets and candidates there are, and only sums
    whose number does not grow with the rows reach the driver. A step that raises a model's objective is halved. Models
    over `PASS_BYTES` of sums are fitted group by group.
    """
    p = 1 + len(features.names)
    group = max(1, PASS_BYTES // (8 * (1 + p + p * p)))
    share = {}
    for s, prep in features.preps.items():
        n, positives = prep.rows, prep.positives
        share[s] = (n / (2.0 * max(1, n - positives)), n / (2.0 * max(1, positives))) if balanced else (1.0, 1.0)
    out: list[Solution] = []
    for first in range(0, len(specs), group):
        part = specs[first:first + group]
        used = np.array([features.used(s) for s in part])
        cost = np.array([1.0 / s.C for s in part])
        ratio = np.array([s.l1_ratio for s in part])
        l1, l2 = cost * ratio, cost * (1 - ratio)
        beta, earlier = np.zeros((len(part), p)), np.zeros((len(part), p))
        lowest, steps, done = np.full(len(part), np.inf), np.zeros(len(part), int), np.zeros(len(part), bool)
        for _ in range(max_iter):
            live = ~done
            if not live.any():
                break
            sums = _sums(rows, features, part, beta, live, share)
            at = np.array([m for m in np.nonzero(live)[0] if m in sums], int)
            done[np.setdiff1d(np.nonzero(live)[0], at)] = True  # sets without rows
            if not len(at):
                break
            values = np.stack([sums[m] for m in at])
            size = np.abs(beta[at, 1:])
            objective = values[:, 0] + l2[at] / 2 * (size**2).sum(axis=1) + l1[at] * size.sum(axis=1)
            worse = objective > lowest[at] + 1e-9 * (1 + np.abs(lowest[at]))
            back, on = at[worse], at[~worse]
            beta[back] = (beta[back] + earlier[back]) / 2
            steps[at] += 1
            if len(on):
                lowest[on], earlier[on] = objective[~worse], beta[on]
                good = values[~worse]
                new = _newton(beta[on], good[:, 1:1 + p], good[:, 1 + p:].reshape(-1, p, p), l1[on], l2[on], used[on], tol)
                moved = np.abs(new - beta[on]).max(axis=1)
                beta[on] = new
                done[on[moved < tol]] = True
        out += [Solution(b, int(n), bool(d)) for b, n, d in zip(beta, steps, done)]
    return out


def score_models(rows: DataFrame, features: Features, asked: dict[int, list[tuple[int, int, np.ndarray]]], column: str, keep: list[str]) -> DataFrame:
    """Scores of rows by models of the sets listed in `column`: the columns `keep`, members, unit, candidate, score.

    `asked` gives for every set the units and candidates with their coefficients; they travel with the code.
    """
    kind = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(n, T.IntegerType()) for n in ("members", "unit", "candidate")], T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _inputs(batch)
            for members, rows_of in _by_set(batch, column):
                models = asked.get(members)
                if not models:
                    continue
                z = features.standardised(x[rows_of], members)
                chance = 1 / (1 + np.exp(-(z @ np.stack([b for _, _, b in models]).T)))
                n, m = chance.shape
                part = batch.take(pa.array(np.repeat(rows_of, m)))
                tags = [np.full(n * m, members, np.int32), np.tile(np.array([u for u, _, _ in models], np.int32), n), np.tile(np.array([c for _, c, _ in models], np.int32), n)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(t) for t in tags], pa.array(chance.ravel())], [*keep, "members", "unit", "candidate", "score"])

    return rows.select(*dict.fromkeys([*keep, "x", column])).mapInArrow(scored, kind)
