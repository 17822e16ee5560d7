"""Packing tokenised documents into sequences of one length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import written

_BLANK = re.compile(rb"[ \t-\r]")
#: Latin letters, which every normal form and case rule leaves alone but for A-Z and their accented kin, then plain punctuation.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")
#: Runs without white space, and words among them, that a Python worker remembers.
CACHE_RUNS, CACHE_WORDS = 150_000, 350_000
_workers: dict[str, "_Worker"] = {}


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Worker:
    """A tokenizer with its memory of words, one per Python process and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.runs: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        # the short way holds for tokenizers that split off letters and lower-case them
        probe = "Ab\u00c9x.,"
        self.short = self.tokenizer.encode(probe, add_special_tokens=False).ids == [t.id for w in ("ab\u00e9x", ".,") for t in self.model.tokenize(self._letters_of(w))]

    def _letters_of(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            ids = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(self._letters_of(word))])
        return ids

    def run(self, run: bytes) -> bytes:
        """Ids of a run without white space."""
        text = run.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text) if self.short else None
        if plain:
            return self._word(plain[1].lower()) + (self._word(plain[2]) if plain[2] else b"")
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def ids(self, runs: list[bytes]) -> bytes:
        known = self.runs
        if len(known) >= CACHE_RUNS:
            known.clear()
        for run in runs:
            if run not in known:
                known[run] = self.run(run)
        return b"".join([known[run] for run in runs])


def _worker(path: str) -> _Worker:
    if path not in _workers:
        _workers[path] = _Worker(path)
    return _workers[path]


def _parts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text cut at white space into parts of about `size` bytes."""
    start = 0
    while start < len(text):
        blank = _BLANK.search(text, start + size)
        stop = blank.start() if blank else len(text)
        yield text[start:stop]
        start = stop


def token_ids(text: bytes, path: str) -> bytes:
    """Ids of a UTF-8 text as little-endian unsigned 32-bit numbers.

    The tokenizer's words never reach over white space, so every run without it is encoded once and remembered.
    """
    worker = _worker(path)
    return b"".join([worker.ids(part.split()) for part in _parts(text)])


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, longest first, each in the first bin that has room.

    A tournament tree holds the room of all bins: every inner node knows the larger of its two, so the first bin with room is
    found by walking down once, to the left wherever the left half has a bin that fits.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i] = node - leaves
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = 4096, seed: int = 7, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most `capacity` ids.

    Each document's ids and `end_id` are cut into full pieces and one rest. Pieces are dealt by a seeded hash into groups of
    about `group_pieces`, and each group is packed on its own, first fit decreasing. Only piece lengths and checksums are
    shuffled, with `keep_ids` also the ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long) and, with `keep_ids`, ids (array of int).
    Null or empty text: one piece with the end id. Null doc_id: kept as null. Repeated rows: pieces of their own; where they
    overfill a group it is packed in runs of four times its size, in bounded memory. Empty table: empty result. Very long
    texts: cut like any other, encoded in parts. Other columns are not read. Reruns give the same places.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids = token_ids(text or b"", tokenizer_path) + end_id.to_bytes(4, "little")
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    for col, value in zip(cols, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, np.frombuffer(piece, "<u4").astype(np.int32))):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.list_(pa.int32())) for c in cols[5:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:5 + keep_ids])

    pieces = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, fields), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("mix", F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32")).withColumn("group", F.pmod("mix", F.lit(groups)))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "mix", "doc_id", "start", "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, used = None, 0

        def packed() -> pa.RecordBatch:
            nonlocal used
            table = pa.Table.from_batches(held)
            lengths = table.column("length").to_pylist()
            bins = first_fit_decreasing(lengths, capacity)
            fill: dict[int, int] = {}
            offsets = []
            for b, length in zip(bins, lengths):
                offsets.append(fill.get(b, 0))
                fill[b] = offsets[-1] + length
            sequence = [(at << 32) + used + b for b in bins]
            used += max(bins) + 1
            columns = [table.column(c).combine_chunks() for c in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
        for batch in batches:
            keys = batch.column("group").to_pylist()
            start = 0
            while start < len(keys):
                if keys[start] != at or sum(b.num_rows for b in held) >= 4 * group_pieces:
                    if held:
                        yield packed()
                    held, used, at = [], used if keys[start] == at else 0, keys[start]
                stop = start
                while stop < len(keys) and keys[stop] == at:
                    stop += 1
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield packed()

    return dealt.mapInArrow(place, fields + ", sequence_id long, offset long")
