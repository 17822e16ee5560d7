"""Document quality by labelling lines as content or boilerplate with a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import LOWER, UPPER, text_of

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = ["bias", "symbols", "upper", "digits", "repeats_previous", "repeats_in_line", "duplicate_line", "sentence_end", "exclamations", "no_words", "length", "word_length", "contact"]
_UPPER, _DIGITS, _WHITE, _LOWER = UPPER.encode(), b"0123456789", b" \t\n\x0b\x0c\r", LOWER.encode()


# ---- statistics and features of one text ----

def _without(text: bytes, letters: bytes) -> int:
    return len(text) - len(text.translate(None, letters))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of `width` (a power of two) words that occur at least twice.

    Window numbers are made by doubling: equal pairs of numbers of half windows get one number, so equality is exact.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    while True:
        pair = ids[:-span] * (n + 1) + ids[span:]
        values, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        span *= 2
        if len(values) == len(pair):
            return 0
        if span == width:
            break
    again = np.nonzero(counts[ids] > 1)[0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def analysed(text: bytes) -> tuple[tuple[int, int, int, int, int], list[list[float]], list[int]]:
    """Statistics (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text, features and words of each line."""
    earlier: set[bytes] = set()
    rows, counts, all_words = [], [], []
    dup_lines = 0
    for line in text.split(b"\n"):
        words = line.split()
        n, size = len(words), max(1, len(line))
        dup = bool(words) and line in earlier
        dup_lines += dup
        if words:
            earlier.add(line)
        last = words[-1][-1:] if words else b""
        rows.append([
            1.0, min(1.0, _without(line, SYMBOLS) / max(1, n)), _without(line, _UPPER) / size, _without(line, _DIGITS) / size, sum(map(eq, words, words[1:])) / max(1, n - 1),
            1.0 - len(set(words)) / max(1, n), float(dup), float(last in (b".", b"!", b"?", b'"')), min(1.0, line.count(b"!") / max(1, n)), float(not words),
            min(1.0, n / 50), min(1.0, size / max(1, n) / 20), float(b"http" in line or b"@" in line),
        ])
        counts.append(n)
        all_words += words
    n_words = len(all_words)
    code_points = len(text) - _without(text, bytes(range(0x80, 0xC0)))
    return (n_words, code_points - _without(text, _WHITE), _without(text, SYMBOLS), dup_lines, repeated_words(all_words)), rows, counts


# ---- the chain ----

@dataclass
class Chain:
    """Weights: `emission` (features x 2 labels) and `transition` (2 x 2); label 0 is content, 1 boilerplate."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels of many line sequences, given one after another in `rows`; all sequences advance together."""
        scores = rows @ self.emission
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[order], starts[order]
        labels = np.zeros(len(rows), np.int8)
        if not len(rows):
            return labels
        back = np.zeros((len(rows), 2), np.int8)
        best = scores[starts]
        for t in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, "left"))
            paths = best[:live, :, None] + self.transition
            back[starts[:live] + t] = paths.argmax(axis=1)
            best[:live] = paths.max(axis=1) + scores[starts[:live] + t]
        now = best.argmax(axis=1).astype(np.int8)
        for t in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            at = starts[:live] + t
            labels[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_chain(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Chain:
    """Maximise the penalised conditional likelihood by gradient steps (Adam); gradients by the forward-backward recursions."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    n, longest, k = len(order), int(lengths[0]), sequences[0].shape[1]
    x, y = np.zeros((n, longest, k)), np.zeros((n, longest), np.int64)
    for row, i in enumerate(order):
        x[row, :lengths[row]], y[row, :lengths[row]] = sequences[i], labels[i]
    mask = np.arange(longest) < lengths[:, None]
    gold = np.stack([mask & (y == 0), mask & (y == 1)], axis=2).astype(float)
    gold_emission = np.einsum("ntk,ntl->kl", x, gold)
    gold_transition = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    total = mask.sum()
    weights, first, second = np.zeros(2 * k + 4), np.zeros(2 * k + 4), np.zeros(2 * k + 4)
    for step in range(1, steps + 1):
        emission, transition = weights[:2 * k].reshape(k, 2), weights[2 * k:].reshape(2, 2)
        scores = x @ emission
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = scores[:, 0]
        live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]
        for t in range(1, longest):
            m = live[t]
            forward[:m, t] = _log_sum(forward[:m, t - 1, :, None] + transition, 1) + scores[:m, t]
        for t in range(longest - 2, -1, -1):
            m = live[t + 1]
            backward[:m, t] = _log_sum(transition + (scores[:m, t + 1] + backward[:m, t + 1])[:, None, :], 2)
        norm = _log_sum(forward[:, 0] + backward[:, 0], 1)
        single = np.exp(forward + backward - norm[:, None, None]) * mask[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + transition + (scores + backward)[:, 1:, None, :] - norm[:, None, None, None]) * mask[:, 1:, None, None]
        gradient = np.concatenate([(gold_emission - np.einsum("ntk,ntl->kl", x, single)).ravel(), (gold_transition - pair.sum(axis=(0, 1))).ravel()]) / total - penalty * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Chain(weights[:2 * k].reshape(k, 2), weights[2 * k:].reshape(2, 2))


def train_line_chain(docs: DataFrame, labels: DataFrame, per_class: int = 1000, max_lines: int = 128) -> Chain | None:
    """A chain fitted on at most `per_class` labelled documents of either quality (0 or 1), chosen by a hash of their ids.

    Lines have no labels of their own. A first chain of single lines learns the label of their document; then the lines of
    poor documents keep the label boilerplate only where that model agrees, and the real chain is fitted on those. A sampled
    document of more than `max_lines` lines gives one run of that many, at a hashed place. Of repeated rows of one doc_id the text
    of the smallest hash is taken, so a sampled id is one row. None where a class is absent.
    """
    ranked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    chosen = [ranked.filter(F.col("quality") == q).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([analysed(t.encode("utf-8", "surrogatepass"))[1] for t in texts])

    rows = features(text_of())
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.size("rows") - max_lines + 1)).cast("int") + 1
    once = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = once.select("doc_id", "quality", rows.alias("rows")).select("doc_id", "quality", F.slice("rows", start, max_lines).alias("rows"))
    taken = sorted(found.collect(), key=lambda r: (r.doc_id, r.quality))
    if len({r.quality for r in taken}) < 2:
        return None
    x = [np.array(r.rows) for r in taken]
    doc_label = [1 - r.quality for r in taken]
    share = [max(1, doc_label.count(v)) for v in (0, 1)]
    keep = [i for v in (0, 1) for i in [j for j, d in enumerate(doc_label) if d == v][:min(share)]]
    x, doc_label = [x[i] for i in keep], [doc_label[i] for i in keep]
    single = fit_chain([line[None] for s in x for line in s], [np.array([v]) for s, v in zip(x, doc_label) for _ in s])
    lines = [np.where((s @ single.emission).argmax(axis=1) == 1, v, 0) if v else np.zeros(len(s), np.int64) for s, v in zip(x, doc_label)]
    return fit_chain(x, lines)


# ---- documents ----

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_KIND = T.StructType([*[T.StructField(c, T.LongType()) for c in STATS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("boilerplate_lines", T.ArrayType(T.IntegerType()))])


def quality_column(text: Column, chain: Chain | None, min_words: int = 20, max_repeat: int = 30, min_content: float = 0.5) -> Column:
    """A struct of `STATS`, base_failed, kept, content_share (of the words) and boilerplate_lines (positions from 0)."""

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            done = [analysed(t.encode("utf-8", "surrogatepass")) for t in texts]
            lengths = np.array([len(d[1]) for d in done], np.int64)
            labels = chain.decode(np.array([r for d in done for r in d[1]]), lengths) if chain and len(done) else np.zeros(int(lengths.sum()), np.int8)
            out, at = [], 0
            for stats, rows, counts in done:
                own = labels[at:at + len(rows)]
                at += len(rows)
                share = float(np.dot(own == 0, counts)) / stats[0] if stats[0] else 1.0
                failed = stats[0] < min_words or 100 * stats[4] > max_repeat * stats[0]
                out.append((*stats, failed, not failed and share >= min_content, share, np.nonzero(own)[0].tolist()))
            yield pd.DataFrame(out, columns=_KIND.fieldNames())

    return F.pandas_udf(batches, _KIND).asNondeterministic()(text)


def judge_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The input's columns as struct `document`, and the fields of `quality_column` for each row.

    Viterbi decoding labels every line of a whole text; a document is kept unless the base rules fail it or content lines hold
    less than `min_content` of its words. The chain is trained on a bounded sample of `labels` (doc_id, quality 0/1); without
    both classes all lines count as content and the base rules decide alone.

    Null or empty text: no words, base rules fail it. Null doc_id: judged like any other, never a training row. Repeated rows:
    judged one by one. Ties in decoding: content. Empty table: empty result. Names cannot clash, the input is one struct.
    """
    chain = train_line_chain(docs, labels)
    judged = docs.select(F.struct("*").alias("document"), quality_column(text_of(), chain, **options).alias("judged"))
    return judged.select("document", "judged.*")


def keep_good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of the input that `judge_documents` keeps, columns unchanged."""
    return judge_documents(docs, labels, **options).filter("kept").select("document.*")
