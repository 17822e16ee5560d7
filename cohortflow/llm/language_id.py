"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import text_of

UNKNOWN = "und"


# ---- features ----

def subword_ids(text: str, buckets: int, widths: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Hashed subwords of a text: all runs of `widths` characters of its lower-cased words, joined and bounded by single blanks.

    Everything but letters separates words; a blank alone is no subword. Runs of one width are hashed together on the array of code points.
    """
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    values, back = np.unique(points, return_inverse=True)
    letter = np.array([chr(v).isalpha() if not 0xD800 <= v < 0xE000 else False for v in values.tolist()], bool)
    kept = np.where(letter, values, 32).astype(np.uint64)[back]
    kept = kept[np.concatenate([[True], (kept[1:] != 32) | (kept[:-1] != 32)])]
    out = []
    for width in widths:
        if len(kept) < width:
            continue
        code = np.full(len(kept) - width + 1, width, np.uint64)
        blanks = np.zeros(len(code), np.int64)
        for j in range(width):
            part = kept[j:len(kept) - width + 1 + j]
            code = (code ^ part) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            blanks += part == 32
        out.append((code[blanks < width] % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


# ---- model ----

@dataclass
class LanguageModel:
    """Embeddings of subword buckets, softmax weights over their average, the calibrating temperature, and the score below which a prediction counts as rejected."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def tables(self) -> np.ndarray:
        """Weights of the languages per bucket: averaging is linear, so embeddings and softmax weights fold into one table."""
        return self.embeddings @ self.weights

    def probabilities(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for start in range(0, len(ids), 1 << 20):  # bounded memory for very long texts
            total += table[ids[start:start + (1 << 20)]].sum(axis=0)
        z = (total / max(1, len(ids)) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _loss(logits: np.ndarray, gold: np.ndarray, temperature: float) -> float:
    z = logits / temperature
    z = z - z.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(gold)), gold]))


def fit_language_model(texts: list[str], gold: list[str], buckets: int = 1 << 14, width: int = 16, epochs: int = 12, rate: float = 0.5, error: float = 0.01, seed: int = 1) -> LanguageModel:
    """Stochastic gradient descent, one text at a time in seeded order; a fifth of the texts only calibrates.

    On that fifth the temperature of least log loss is taken, and the rejection threshold is the smallest score above which
    the share of wrong predictions is at most `error`.
    """
    languages = sorted(set(gold))
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    items = [(subword_ids(t, buckets), number[g]) for t, g in zip(texts, gold)]
    items = [x for x in items if len(x[0])]
    order = rng.permutation(len(items))
    held, train = order[:len(items) // 5], order[len(items) // 5:]
    embeddings = rng.normal(scale=1 / width, size=(buckets, width))
    weights, bias = np.zeros((width, len(languages))), np.zeros(len(languages))
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, y = items[i]
            bags, counts = np.unique(ids, return_counts=True)
            share = counts / len(ids)
            hidden = share @ embeddings[bags]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            now = rate * (1 - done / steps)
            back = weights @ p
            weights -= now * np.outer(hidden, p)
            bias -= now * p
            embeddings[bags] -= now * len(bags) * share[:, None] * back / 8
            done += 1
    model = LanguageModel(languages, embeddings, weights, bias)
    if len(held):
        table = model.tables()
        logits = np.array([table[items[i][0]].mean(axis=0) + bias for i in held])
        y = np.array([items[i][1] for i in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 80))
        model.temperature = float(min(grid, key=lambda t: _loss(logits, y, t)))
        z = logits / model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        score, wrong = p.max(axis=1), p.argmax(axis=1) != y
        rank = np.argsort(-score)
        rates = np.cumsum(wrong[rank]) / np.arange(1, len(rank) + 1)
        fine = np.nonzero(rates <= error)[0]
        model.threshold = float(score[rank][fine[-1]]) if len(fine) else 1.0
    return model


def train_language_model(docs: DataFrame, per_language: int = 600, sample_chars: int = 2000, max_texts: int = 40_000, **options) -> LanguageModel | None:
    """A model fitted on a bounded sample of rows with a language and letters: at most `per_language` of each.

    Rows are chosen by a hash of doc_id and text, whose bar per language follows from the language's row count; of a long text
    a run of `sample_chars` at a hashed place is taken. Every language is learned: where there are many, each gives an equal
    share of `max_texts` rows, one at least. None without any such row.
    """
    labelled = docs.select("doc_id", text_of().alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return None
    per_language = min(per_language, max(1, max_texts // len(found)))
    mixed = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30))
    bars = docs.sparkSession.createDataFrame([(r.lang, int((1 << 30) * min(1.0, (1.2 * per_language + 20) / r.n))) for r in found], "known string, bar long")
    start = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int") + 1
    drawn = labelled.withColumn("draw", mixed).join(F.broadcast(bars), F.col("lang") == F.col("known")).filter(F.col("draw") < F.col("bar"))
    rows = drawn.select("lang", "draw", F.substring("text", start, F.lit(sample_chars)).alias("text")).orderBy("draw", "lang", "text").limit((2 * per_language + 40) * len(found)).collect()
    taken: dict[str, list[str]] = {}
    for r in rows:
        if len(taken.setdefault(r.lang, [])) < per_language:
            taken[r.lang].append(r.text)
    pairs = [(t, lang) for lang in sorted(taken) for t in taken[lang]]
    return fit_language_model([t for t, _ in pairs], [g for _, g in pairs], **options) if pairs else None


_KIND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def language_column(text: Column, model: LanguageModel | None) -> Column:
    """Struct of lang_pred, score (calibrated probability) and accepted of a whole text."""

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = model.tables() if model else None
        for texts in parts:
            out = []
            for text in texts:
                ids = subword_ids(text, len(table)) if model and text else ()
                if len(ids):
                    p = model.probabilities(ids, table)
                    best = int(p.argmax())
                    out.append((model.languages[best], float(p[best]), bool(p[best] >= model.threshold)))
                else:
                    out.append((UNKNOWN, 0.0, False))
            yield pd.DataFrame(out, columns=_KIND.fieldNames())

    return F.pandas_udf(batches, _KIND).asNondeterministic()(text)


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The input's columns as struct `document`, with lang_pred, score and accepted of its whole text.

    Only the text is looked at. Null text or no letter: `und`, score 0, not accepted; so is every row without a model. Ties go
    to the first language by code points. `accepted` is the calibrated rejection; lang_pred names the best language either
    way. Null doc_id, repeated rows: judged like any other. Empty table: empty result. Very long texts: whole, in parts.
    """
    return docs.select(F.struct("*").alias("document"), language_column(text_of(), model).alias("found")).select("document", "found.*")
