"""Vector codes: every part of a vector becomes the number of its nearest codebook entry, by exact integer products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import written

#: Label totals up to this many are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Vectors that one block of products holds.
BLOCK = 4096


def integer_vectors(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose vector is whole (not null, not empty, no null or non-finite component), with `v`: floor(scale * x) as longs."""
    x = F.transform(column, lambda c: c.cast("double"))
    whole = (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).withColumn("v", F.transform(x, lambda c: F.floor(c * float(scale))))


# ---- exact products ----

def limb_bits(width: int) -> int:
    """The most bits of a limb for which sums of `width` products of two limbs stay below 2^53."""
    return (53 - max(0, (max(1, width) - 1).bit_length())) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Parts of integers with values = sum(part_i * 2^(i * bits)), all but the last in [0, 2^bits), as float64."""
    top = int(np.abs(values).max(initial=0))
    out = []
    while top >= 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
        top = (top >> bits) + 1
    return [*out, values.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices: float64 products of limbs, each exact, put together in int64."""
    bits = limb_bits(a.shape[1])
    right = limbs(b, bits)
    total = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            total += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and the squared distance, for every row."""
    scores = (entries * entries).sum(axis=1) - 2 * exact_products(part, entries)
    index = scores.argmin(axis=1)
    return index, scores[np.arange(len(part)), index] + (part * part).sum(axis=1)


def encode(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and errors (rows) of integer vectors under codebooks (parts x entries x width)."""
    parts, _, width = codebooks.shape
    codes, error = np.empty((len(vectors), parts), np.int64), np.zeros(len(vectors), np.int64)
    for p in range(parts):
        codes[:, p], far = nearest(vectors[:, p * width:(p + 1) * width], codebooks[p])
        error += far
    return codes, error


def component_limit(width: int) -> int:
    """Components below this keep every squared distance over `width` dimensions within a long."""
    return 1 << ((62 - max(0, (width - 1).bit_length())) // 2 - 1)


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch with their vectors as an int64 matrix; vectors of another length or beyond the limit are an error."""
    limit = component_limit(size)
    for start in range(0, batch.num_rows, BLOCK):
        piece = batch.slice(start, BLOCK)
        column = piece.column("v")
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if (np.diff(column.offsets.to_numpy()) != size).any():
            raise ValueError(f"vectors must have {size} components")
        if ((flat >= limit) | (flat <= -limit)).any():
            raise ValueError(f"components must stay below {limit}: a squared distance would not fit a long")
        yield piece, flat.reshape(-1, size)


# ---- codebooks ----

def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of the smallest ids (ids ascending, null last, then by vector); None for an empty table."""
    rows = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return None
    size = len(rows[0].v)
    if size % parts or any(len(r.v) != size for r in rows):
        raise ValueError(f"vectors must have one length divisible by {parts}")
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, size // parts).transpose(1, 0, 2).copy()


def refine(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks with every used entry replaced by the floor of the mean of what it is nearest to.

    Each task adds up its rows and sends at most one sum per entry; only these sums are shuffled and collected.
    """
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, block in _blocks(batch, parts * width):
                codes, _ = encode(block, codebooks)
                slots = (codes + np.arange(parts) * entries).ravel()
                np.add.at(total, slots, block.reshape(-1, width))
                count += np.bincount(slots, minlength=parts * entries)
        used = np.nonzero(count)[0]
        if len(used):
            offsets = pa.array(np.arange(len(used) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(total[used].ravel())), pa.array(count[used])], ["slot", "total", "n"])

    partial = vectors.select("v").mapInArrow(sums, "slot int, total array<long>, n long")
    summed = partial.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)])
    out = codebooks.reshape(parts * entries, width).copy()
    for row in summed.collect():
        out[row.slot] = [row[f"t{i}"] // row.n for i in range(width)]
    return out.reshape(codebooks.shape)


def train_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks (parts x entries x width) after `rounds` of assignment and averaging over all vectors."""
    codebooks = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if codebooks is not None else 0):
        codebooks = refine(vectors, codebooks)
    return codebooks


def codebook_digest(codebooks: np.ndarray | None) -> str:
    """SHA-256 of all integers, joined by commas, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist() if codebooks is not None else [])).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, codebooks: np.ndarray | None) -> DataFrame:
    """The columns of `vectors` but `v`, with `code` (two hexadecimal digits a part) and `error` (long)."""
    kept = [f for f in vectors.schema.fields if f.name != "v"]
    kind = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, block in _blocks(batch, codebooks.shape[0] * codebooks.shape[2]):
                codes, error = encode(block, codebooks)
                text = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([*[piece.column(f.name) for f in kept], text, pa.array(error)], [*[f.name for f in kept], "code", "error"])

    return vectors.mapInArrow(coded, kind)


def compress_vectors(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code, error, label_error of every whole vector of `table` (vec_id, embedding, label), and the codebooks.

    Codebooks start as the parts of the `entries` smallest ids and are refined over all rows. Products are exact: integers are
    cut into limbs whose float64 products stay below 2^53. label_error is the sum of error over equal labels, nulls together.

    Vectors that are null, empty or hold a null or non-finite component take no part. Vectors of several lengths, of a length
    that `parts` does not divide, or so large that a squared distance would not fit a long: ValueError. Null vec_id: coded like
    any other, a first entry only where ids are too few. Repeated ids: one row each, in the order of their vectors as first
    entries. Equal distances: the lower entry. Fewer rows than entries: as many entries as rows. Empty table: empty result, no
    codebooks. At most 256 entries, so that two digits hold an index.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    vectors = written(integer_vectors(table.select("vec_id", "embedding", "label"), "embedding", scale).select("vec_id", "label", "v"), "vectors")
    codebooks = train_codebooks(vectors, parts, entries, rounds)
    coded = written(encode_vectors(vectors, codebooks), "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "label-errors")
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "label", "code", "error", "label_error"), codebooks
