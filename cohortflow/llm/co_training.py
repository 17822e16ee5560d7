"""Document quality by co-training a classifier of the text with one of the page's metadata."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import text_of, written

WORD_BUCKETS = 256
SOURCE_BUCKETS, LANG_BUCKETS, HOST_BUCKETS = 32, 8, 16
#: Numeric metadata of a document and its page.
PAGE_NUMBERS = ["n_pages", "https", "has_query", "has_fragment", "log_html", "links", "scripts", "items", "paragraphs"]


# ---- views ----

def text_features(text: bytes) -> np.ndarray:
    """Content view: shares of kinds of characters and words, repetition, line shape, and a hashed bag of words."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    without = lambda letters: (len(text) - len(text.translate(None, letters))) / size
    counts = Counter(words)
    bag = np.zeros(WORD_BUCKETS)
    for word, times in counts.items():
        bag[zlib.crc32(word) % WORD_BUCKETS] += times
    stats = [
        np.log1p(len(words)) / 10, without(b"#*$%&|<>"), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"0123456789"), without(b"!?"), without(b".,;:"), size / n / 10,
        len(counts) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(counts.values(), default=0) / n, sum(w.isupper() for w in words) / n,
        len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)) / 50, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
    ]
    return np.concatenate([stats, np.sqrt(bag / n)])


def page_table(pages: DataFrame) -> DataFrame:
    """Metadata per document (page_doc, host, PAGE_NUMBERS) of pages (url, html) whose address ends in the document's number.

    Several pages of one document are combined by partial sums and maxima, however many they are.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    per_kb = lambda tag: F.regexp_count(html, F.lit(tag)) * 1000.0 / F.greatest(F.lit(1), F.length(html))
    one = pages.select(
        F.regexp_extract(url, r"/(\d{1,18})(?:\.html?)?/?(?:[?#].*)?$", 1).try_cast("long").alias("page_doc"), F.regexp_extract(url, r"^\w+://(?:www\.|m\.|blog\.)?([^/?#]+)", 1).alias("host"),
        url.startswith("https:").cast("double").alias("https"), url.contains("?").cast("double").alias("has_query"), url.contains("#").cast("double").alias("has_fragment"), F.log1p(F.length(html)).alias("log_html"),
        per_kb("<a ").alias("links"), per_kb("<script").alias("scripts"), per_kb("<li").alias("items"), per_kb("<p[ >]").alias("paragraphs"))
    return one.filter(F.col("page_doc").isNotNull()).groupBy("page_doc").agg(F.min("host").alias("host"), F.log1p(F.count(F.lit(1))).alias("n_pages"), *[F.max(c).alias(c) for c in PAGE_NUMBERS[1:]])


def page_features(frame: pd.DataFrame) -> np.ndarray:
    """Metadata view of rows with source, lang, n_chars, host and PAGE_NUMBERS; absent pages are zeros."""
    numbers = frame[PAGE_NUMBERS].fillna(0.0).to_numpy(float)
    length = np.log1p(frame["n_chars"].fillna(0).clip(lower=0).to_numpy(float))[:, None]
    parts = [numbers, length, frame["host"].notna().to_numpy(float)[:, None]]
    for column, buckets in (("source", SOURCE_BUCKETS), ("lang", LANG_BUCKETS), ("host", HOST_BUCKETS)):
        hot = np.zeros((len(frame), buckets))
        for i, value in enumerate(frame[column]):
            if isinstance(value, str):
                hot[i, zlib.crc32(value.encode("utf-8", "surrogatepass")) % buckets] = 1.0
        parts.append(hot)
    return np.concatenate(parts, axis=1)


# ---- classifiers ----

@dataclass
class View:
    """A logistic classifier of one view: standardised inputs, weights, and the line that calibrates its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return np.clip(self.slope * z + self.shift, -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Weights (constant first) of a penalised logistic regression, by Newton steps with halving."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    ridge = np.full(a.shape[1], penalty)
    ridge[0] = 1e-6
    loss = lambda b: float(weight @ (np.logaddexp(0, a @ b) - y * (a @ b)) + 0.5 * ridge @ b**2)
    b, now = np.zeros(a.shape[1]), np.inf
    for _ in range(steps):
        p = _sigmoid(a @ b)
        gradient = a.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge), gradient)
        part = 1.0
        while loss(b - part * step) > loss(b) and part > 1e-4:
            part /= 2
        b = b - part * step
        if abs(now - loss(b)) < 1e-7 * (1 + abs(now)):
            break
        now = loss(b)
    return b


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    return View(mean, scale, _logistic(np.clip((x - mean) / scale, -8, 8), y, weight, penalty))


def _calibrate(view: View, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    view.slope, view.shift = 1.0, 0.0
    shift, slope = _logistic(view.log_odds(x)[:, None], y, weight, penalty=0.1)
    view.slope, view.shift = float(max(0.0, slope)), float(shift)


@dataclass
class CoTrained:
    """Both views and the weights (constant, content, metadata) that combine their calibrated log odds."""

    text: View
    page: View
    combined: np.ndarray
    pseudo: list[tuple[int, int]] = field(default_factory=list)

    def log_odds(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        return self.combined[0] + self.combined[1] * text + self.combined[2] * page


#: Of a view (`text` or `page`) and the ids already given to the other view: new ids, their labels 0 or 1, and their features in the other view.
Draw = Callable[[str, View, set], tuple[list, np.ndarray, np.ndarray]]
OTHER = {"text": "page", "page": "text"}


def array_draw(text: np.ndarray, page: np.ndarray, rows: np.ndarray, per_round: int = 100, sure: float = 0.95) -> Draw:
    """Draws from rows of arrays: at most `per_round` of each class, the most confident beyond `sure`."""
    features = {"text": text, "page": page}

    def draw(name: str, view: View, taken: set) -> tuple[list, np.ndarray, np.ndarray]:
        own = rows[~np.isin(rows, list(taken))]
        p = _sigmoid(view.log_odds(features[name][own])) if len(own) else np.empty(0)
        order = np.argsort(p, kind="stable")
        low = [own[i] for i in order[:per_round] if p[i] <= 1 - sure]
        high = [own[i] for i in order[::-1][:per_round] if p[i] >= sure]
        at = np.array(low + high, np.int64)
        return at.tolist(), np.array([0] * len(low) + [1] * len(high)), features[OTHER[name]][at]

    return draw


def co_train(text: np.ndarray, page: np.ndarray, labels: np.ndarray, prior: tuple[float, float] = (1.0, 1.0), rounds: int = 4, draw: Draw | None = None, seed: int = 3, **limits) -> CoTrained:
    """Co-training on rows with both views; labels 0, 1 or -1 (none).

    A fifth of the labelled rows only calibrates. In every round both views are fitted and calibrated; each then labels its
    most confident unlabelled rows for the training set of the other. `draw` finds those rows; without it they are the rows
    of the arrays without a label (`limits` as in `array_draw`). Last, both calibrated views are combined by a regression on
    the calibrating rows. `prior` weighs the classes.
    """
    rng = np.random.default_rng(seed)
    known = rng.permutation(np.nonzero(labels >= 0)[0])
    held = np.concatenate([known[labels[known] == c][: max(1, int((labels[known] == c).sum()) // 5)] for c in (0, 1)])
    base = np.setdiff1d(known, held)
    if len(set(labels[base])) < 2:
        base = known
    draw = draw or array_draw(text, page, np.nonzero(labels < 0)[0], **limits)
    features = {"text": text, "page": page}
    train = {v: ([features[v][base]], [labels[base]]) for v in features}
    taken: dict[str, set] = {v: set() for v in features}
    weigh = lambda y: np.where(np.asarray(y) == 1, prior[1], prior[0])
    views: dict[str, View] = {}
    given: list[tuple[int, int]] = []

    def refit() -> None:
        for name, x in features.items():
            y = np.concatenate(train[name][1]).astype(float)
            views[name] = fit_view(np.concatenate(train[name][0]), y, weigh(y))
            _calibrate(views[name], x[held], labels[held].astype(float), weigh(labels[held]))

    refit()
    for _ in range(rounds):
        gained = []
        for name, other in OTHER.items():
            ids, y, x = draw(name, views[name], taken[other])
            if len(ids):
                train[other][0].append(x)
                train[other][1].append(y)
                taken[other] |= set(ids)
            gained.append(len(ids))
        given.append((gained[0], gained[1]))
        if not any(gained):
            break
        refit()
    stacked = np.stack([views["text"].log_odds(text[held]), views["page"].log_odds(page[held])], axis=1)
    combined = _logistic(stacked, labels[held].astype(float), weigh(labels[held]), penalty=0.1)
    combined[1:] = np.maximum(combined[1:], 0.0)
    return CoTrained(views["text"], views["page"], combined, given)


# ---- documents ----

def _features_column() -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t.encode("utf-8", "surrogatepass")) for t in texts])

    return features(text_of())


def _table_draw(texts: DataFrame, pages: DataFrame, known: DataFrame, per_round: int, sure: float) -> Draw:
    """Draws from all unlabelled documents, scored where they lie: only the chosen rows, `per_round` of a class, reach the driver.

    `texts` has doc_id and x, `pages` doc_id and the metadata, `known` the doc_id of what has a label. Most confident first, equal ones by doc_id; an id counts once.
    """
    tables = {"text": texts, "page": pages}
    inputs = {"text": lambda frame: np.stack(frame["x"].to_numpy()).astype(float), "page": page_features}

    def draw(name: str, view: View, taken: set) -> tuple[list, np.ndarray, np.ndarray]:
        def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    p = _sigmoid(view.log_odds(inputs[name](frame)))
                    clear = (p <= 1 - sure) | (p >= sure)
                    yield pd.DataFrame({"doc_id": frame["doc_id"][clear], "p": p[clear]})

        clear = tables[name].mapInPandas(scored, "doc_id long, p double")
        clear = clear.filter(~F.col("doc_id").isin(sorted(taken))) if taken else clear
        clear = clear.join(known, "doc_id", "left_anti")
        found: dict[int, int] = {}
        for label, side in ((0, clear.filter(F.col("p") <= 1 - sure).orderBy("p", "doc_id")), (1, clear.filter(F.col("p") >= sure).orderBy(F.desc("p"), "doc_id"))):
            for r in side.limit(per_round).collect():
                found.setdefault(r.doc_id, label)
        other = OTHER[name]
        chosen = tables[other].filter(F.col("doc_id").isin(sorted(found))).toPandas() if found else None
        if chosen is None or not len(chosen):
            return [], np.empty(0, np.int64), np.empty((0, 0))
        chosen = chosen.assign(_tie=chosen.astype(str).agg("|".join, axis=1)).sort_values(["doc_id", "_tie"]).drop_duplicates("doc_id").reset_index(drop=True)
        ids = [int(i) for i in chosen["doc_id"]]
        return ids, np.array([found[i] for i in ids]), inputs[other](chosen)

    return draw


def train_quality_model(docs: DataFrame, labels: DataFrame, pages: DataFrame, per_class: int = 1500, per_round: int = 100, sure: float = 0.95, **options) -> CoTrained | None:
    """A model co-trained on `per_class` labelled documents of either class, by a hash of their ids, and on all unlabelled documents.

    Both views of the unlabelled documents are written once; every round each view scores all of them and labels the
    `per_round` most confident of either class for the other. Only features of the training rows reach the driver; of
    repeated rows of a labelled doc_id the text of the smallest hash is taken. None where a class has no labelled document.
    """
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return None
    chosen = [labels.filter(F.col("quality") == c).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"))
    meta = page_table(pages)
    once = narrow.join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "source", "lang", "n_chars"), F.struct(F.xxhash64("text"), "n_chars", "source", "lang")).alias("d")).select("doc_id", "quality", "d.*")
    rows = once.select("doc_id", "quality", "source", "lang", "n_chars", _features_column().alias("text"))
    frame = rows.join(meta, rows["doc_id"] == meta["page_doc"], "left").drop("page_doc").toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    y = frame["quality"].to_numpy(np.int64)
    if (y == 0).sum() < 2 or (y == 1).sum() < 2:
        return None
    prior = tuple(total[c] / max(1, (y == c).sum()) for c in (0, 1))
    scale = (prior[0] * (y == 0).sum() + prior[1] * (y == 1).sum()) / (y >= 0).sum()

    named = narrow.filter(F.col("doc_id").isNotNull())
    texts = written(named.select("doc_id", _features_column().cast("array<float>").alias("x")), "content-views")
    views = written(named.drop("text").join(meta, named["doc_id"] == meta["page_doc"], "left").drop("page_doc"), "page-views")
    draw = _table_draw(texts, views, written(labels.select("doc_id"), "known"), per_round, sure)
    return co_train(np.stack(frame["text"].to_numpy()), page_features(frame), y, (prior[0] / scale, prior[1] / scale), draw=draw, **options)


def score_quality(docs: DataFrame, labels: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """doc_id, text_score, page_score, score (probabilities of good quality) and kept (score of a half or more) of every row.

    The content view reads whole texts where they lie; only its log odds and the narrow metadata meet the pages' metadata, so
    texts are never shuffled. Without both classes among the labels every score is null and every row kept.

    Null text: scored as an empty one. Null doc_id: scored without a page. Null source, lang, n_chars or no page: zeros in the
    metadata view. Repeated rows: each scored. Very long texts: whole. Empty table: empty result. Other columns are not read.
    """
    kind = "doc_id long, text_score double, page_score double, score double, kept boolean"
    model = train_quality_model(docs, labels, pages, **options)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long"), nothing.alias("text_score"), nothing.alias("page_score"), nothing.alias("score"), F.lit(True).alias("kept"))

    @F.pandas_udf(T.DoubleType())
    def content(texts: pd.Series) -> pd.Series:
        return pd.Series(model.text.log_odds(np.stack([text_features(t.encode("utf-8", "surrogatepass")) for t in texts])) if len(texts) else [], dtype=float)

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            page = model.page.log_odds(page_features(frame))
            text = frame["text_odds"].to_numpy(float)
            score = _sigmoid(model.log_odds(text, page))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_score": _sigmoid(text), "page_score": _sigmoid(page), "score": score, "kept": score >= 0.5})

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double"), content(text_of()).alias("text_odds"))
    joined = narrow.join(page_table(pages), F.col("doc_id") == F.col("page_doc"), "left").drop("page_doc")
    return joined.mapInPandas(combine, kind)
