import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortflow.llm.co_training import _logistic, co_train, page_features, page_table, score_quality, text_features, train_quality_model


def area(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    good = y == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_logistic_gradient_vanishes():
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(200, 4)), (rng.random(200) < 0.4).astype(float), rng.random(200)
    b = _logistic(x, y, w, 0.7)
    a = np.concatenate([np.ones((200, 1)), x], axis=1)
    gradient = a.T @ (w * (1 / (1 + np.exp(-a @ b)) - y)) + np.array([1e-6, 0.7, 0.7, 0.7, 0.7]) * b
    assert np.abs(gradient).max() < 1e-3


def test_views_teach_each_other():
    """Few labels; the second view alone is noisy, and pseudo-labels of the first lift it."""
    rng = np.random.default_rng(1)
    y = (rng.random(1500) < 0.5).astype(int)
    text = np.stack([3.0 * y + rng.normal(size=1500), *rng.normal(size=(5, 1500))], axis=1)
    page = np.concatenate([1.2 * y[:, None] + rng.normal(size=(1500, 1)), rng.normal(size=(1500, 25))], axis=1)
    labels = np.where(np.arange(1500) < 40, y, -1)
    before = co_train(text, page, labels, rounds=0)
    after = co_train(text, page, labels, rounds=6)
    fresh = np.arange(1500) >= 40
    assert sum(a for a, _ in after.pseudo) > 100
    assert area(after.page.log_odds(page)[fresh], y[fresh]) > area(before.page.log_odds(page)[fresh], y[fresh]) + 0.02
    both = after.log_odds(after.text.log_odds(text), after.page.log_odds(page))
    assert area(both[fresh], y[fresh]) > 0.95 and ((both > 0) == y)[fresh].mean() > 0.85


def test_page_table(spark):
    rows = [("https://www.a.example/en/12?x=1", "<p>a</p><a href=1>b</a>"), ("http://m.b.example/x/12.html", None), ("http://c.example/7/#top", "<li>"), ("http://c.example/none", ""), (None, None)]
    got = {r.page_doc: r for r in page_table(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert set(got) == {12, 7} and got[12].host == "a.example" and got[12].https == 1.0 and got[12].has_query == 1.0 and got[7].has_fragment == 1.0
    assert abs(got[12].n_pages - np.log(3)) < 1e-12


def test_features_handle_nulls_and_empty():
    assert np.isfinite(text_features(b"")).all() and len(text_features(b"a b\nc")) == len(text_features(b""))
    frame = pd.DataFrame({"source": [None, "s"], "lang": ["en", None], "n_chars": [None, 5.0], "host": [None, "h"], **{c: [None, 1.0] for c in ["n_pages", "https", "has_query", "has_fragment", "log_html", "links", "scripts", "items", "paragraphs"]}})
    assert np.isfinite(page_features(frame).astype(float)).all()


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, quality = [], []
    for i in range(240):
        good = i % 4 > 0
        words = [word() for _ in range(rng.randint(20, 60))]
        text = " ".join(words) + "." if good else " ".join(rng.choice(["### ", "$$$ ", "| "]) + w for w in words[:10] * 4)
        rows.append((i, text, "en", f"src{i % 3}"))
        quality.append((i, int(good)))
    return rows, quality


def test_documents(spark, docs_of):
    rows, quality = corpus()
    edge = [(None, rows[1][1]), (900, None), (901, ""), (902, "word " * 200_000), rows[2], rows[2], (903, rows[5][1], None, None)]
    docs = docs_of(rows + edge).withColumn("score", F.lit("clash")).withColumn("host", F.lit(1))
    labels = spark.createDataFrame([q for q in quality if q[0] < 150] + [(None, 1), (3, None)], "doc_id long, quality int")
    pages = spark.createDataFrame([(i, f"https://h{i % 5}.example/en/{i}", "<p>x</p>") for i in range(0, 240, 2)] + [(1000, None, None)], "page_id long, url string, html string")
    out = score_quality(docs, labels, pages, per_class=60).collect()
    assert len(out) == len(rows) + len(edge)
    by_id = {r.doc_id: r for r in out}
    fresh = np.array([i for i, _ in quality if i >= 150])
    y = np.array([quality[i][1] for i in fresh])
    score = np.array([by_id[i].score for i in fresh])
    assert area(score, y) > 0.97 and ((score >= 0.5) == (y == 1)).mean() > 0.95
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in out) and by_id[None].kept
    again = score_quality(docs.repartition(5), labels, pages, per_class=60).collect()
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in again) == sorted((r.doc_id or -1, round(r.score, 9)) for r in out)
    assert score_quality(docs.limit(0), labels, pages).collect() == []
    assert train_quality_model(docs, labels.filter("quality = 1"), pages) is None
    assert all(r.kept and r.score is None for r in score_quality(docs, labels.limit(0), pages).collect())


def test_any_unlabelled_document_can_be_given_a_label(spark):
    """Draws from tables equal draws from arrays over all rows, taken ids left out."""
    from cohortflow.llm.co_training import PAGE_NUMBERS, _table_draw, array_draw, fit_view

    rng = np.random.default_rng(2)
    n = 5000
    text = np.round(rng.normal(size=(n, 3)), 3)
    names = ["doc_id", "source", "lang", "n_chars", "host", *PAGE_NUMBERS]
    frame = pd.DataFrame({"doc_id": np.arange(n), "source": "s", "lang": "en", "n_chars": rng.integers(1, 99, n).astype(float), "host": "h", **{c: rng.normal(size=n) for c in PAGE_NUMBERS}})[names]
    page = page_features(frame)
    texts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(text)], "doc_id long, x array<float>").repartition(5)
    known = spark.createDataFrame([(i,) for i in range(0, n, 10)], "doc_id long")
    table = _table_draw(texts, spark.createDataFrame(frame).repartition(3), known, 30, 0.9)
    plain = array_draw(text.astype(np.float32).astype(float), page, np.array([i for i in range(n) if i % 10]), 30, 0.9)
    y = (text[:, 0] > 0).astype(float)
    for name, x in (("text", text), ("page", page)):
        view = fit_view(x[:400], y[:400] if name == "text" else (page[:400, 0] > 0).astype(float), np.ones(400))
        a, b = table(name, view, {7, 11}), plain(name, view, {7, 11})
        want = dict(zip(b[0], b[1]))
        assert dict(zip(a[0], a[1])) == want and len(want) == 60 and not {7, 11} & set(want)
        assert np.allclose(a[2], np.stack([dict(zip(b[0], b[2]))[i] for i in a[0]]), atol=1e-6)
