"""Fill-in-the-middle examples: texts cut at seeded places, found by selection in a compressed set of code point boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import text_of

# The marks before prefix, suffix and middle, and the forms of an example.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: A container holds the boundaries of 2^16 bytes: sorted low halves, a bitmap, or runs, whichever is smallest.
CHUNK = 1 << 16
ARRAY_LIMIT = 4096


# ---- the boundary set ----

class ArrayContainer:
    """Sorted low halves; for few values."""

    def __init__(self, lows: np.ndarray):
        self.lows = lows.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.lows[rank])


class BitmapContainer:
    """One bit per value with the counts before each word of 64."""

    def __init__(self, member: np.ndarray):
        bits = np.zeros(CHUNK, bool)
        bits[: len(member)] = member
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.before, rank, "right")) - 1
        ones = np.nonzero(np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little"))[0]
        return word * 64 + int(ones[rank - int(self.before[word])])


class RunContainer:
    """Starts of runs of neighbouring values with the counts before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.starts[run]) + rank - int(self.before[run])


Container = ArrayContainer | BitmapContainer | RunContainer


def container(member: np.ndarray) -> tuple[Container, int]:
    """The smallest container of the set places of a boolean array (at most 2^16 long), and how many it holds."""
    count = int(np.count_nonzero(member))
    step = np.diff(member.view(np.int8), prepend=0, append=0)
    starts = np.nonzero(step == 1)[0]
    array_bytes = 2 * count if count <= ARRAY_LIMIT else CHUNK
    if 2 + 4 * len(starts) <= min(array_bytes, CHUNK // 8):
        return RunContainer(starts, np.nonzero(step == -1)[0] - starts), count
    if array_bytes <= CHUNK // 8:
        return ArrayContainer(np.nonzero(member)[0]), count
    return BitmapContainer(member), count


class BoundarySet:
    """The byte places at which code points of a UTF-8 text start, and its end: containers with cumulative cardinalities.

    `select(i)` is the place behind the first i code points: a search for the container, then a selection in it.
    """

    def __init__(self, data: np.ndarray):
        self.keys: list[int] = []
        self.containers: list[Container] = []
        counts = [0]
        for start in range(0, len(data) + 1, CHUNK):
            part = data[start:start + CHUNK]
            member = np.ones(min(CHUNK, len(data) + 1 - start), bool)
            member[: len(part)] = (part & 0xC0) != 0x80
            held, count = container(member)
            if count:
                self.keys.append(start // CHUNK)
                self.containers.append(held)
                counts.append(counts[-1] + count)
        self.before = np.array(counts, np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        return self.keys[at] * CHUNK + self.containers[at].select(rank - int(self.before[at]))


# ---- examples ----

def infill(text: bytes, draws: tuple[int, int, int, int], plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output for one text."""
    boundaries = BoundarySet(np.frombuffer(text, np.uint8))
    n = len(boundaries) - 1
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or any(m in text for m in marks) or draws[2] % 100 >= plain_from:
        return n, PLAIN, None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    i, j = boundaries.select(low), boundaries.select(high)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if draws[3] % 100 < spm_below:
        return n, SPM, low, high - low, b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle])
    return n, PSM, low, high - low, b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle])


_OUT = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of `docs`.

    Draws are the first four groups of eight hexadecimal digits of the SHA-256 of `seed`:doc_id. Of a text of n code points the
    first and second draw modulo n + 1 are the cuts, the smaller first; the third modulo 100 says plain from `plain_from` on,
    the fourth suffix-prefix-middle below `spm_below`, else prefix-suffix-middle. Texts that are empty or hold a mark stay plain.

    Null or empty text: n 0, plain, empty output. Null doc_id: drawn from `seed`: alone. Rows of one doc_id share their draws;
    repeated rows give repeated results. Empty table: empty result. Very long texts: whole, in linear time, with at most one
    container for 2^16 bytes. Other columns are not read. prefix_chars and middle_chars are null for plain texts.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    narrow = docs.select("doc_id", text_of().alias("text"), *[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    kind = T.StructType([narrow.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            draws = [batch.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4)]
            for start in range(0, batch.num_rows, 500):
                rows = [infill(t, d, plain_from, spm_below) for t, d in zip(texts.slice(start, 500).to_pylist(), zip(*[c[start:start + 500] for c in draws]))]
                columns = [pa.array([r[i] for r in rows], of) for i, (_, of) in enumerate(_OUT[:-1])]
                output = pa.array([r[4] for r in rows], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, 500), *columns, output], ["doc_id", *[name for name, _ in _OUT]])

    return narrow.mapInArrow(cut, kind)


def restored(output: Column, form: Column) -> Column:
    """The text of an example: its pieces in their first order. No mark can arise where pieces and marks meet."""
    pieces = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm = F.concat(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(2)))
    spm = F.concat(F.get(pieces, F.lit(2)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(1)))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
