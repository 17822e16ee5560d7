import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.line_crf import Chain, analysed, fit_chain, judge_documents, keep_good_documents, repeated_words, train_line_chain


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@pytest.mark.parametrize("seed", range(6))
def test_statistics(seed):
    rng = random.Random(seed)
    vocab = ["a", "é#", "Größe", "日本|", "x$<>", "end.", "\U0001f600"][: 2 + seed]
    text = "".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "  ", "\x0b", " "]) for _ in range(rng.choice([0, 5, 120])))
    assert analysed(text.encode())[0] == slow_stats(text)
    assert repeated_words([b"a"] * 9) == 9 and repeated_words([b"a"] * 8) == 0 and repeated_words([]) == 0


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(3)
    chain = Chain(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    lengths = np.array([1, 6, 3, 0, 5])
    rows = rng.normal(size=(lengths.sum(), 3))
    got, at = chain.decode(rows, lengths), 0
    for n in lengths:
        scores = rows[at:at + n] @ chain.emission
        value = lambda p: sum(scores[t, s] for t, s in enumerate(p)) + sum(chain.transition[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(got[at:at + n]) == max(itertools.product((0, 1), repeat=int(n)), key=value)
        at += n


def test_training_raises_the_likelihood_and_recovers_labels():
    rng = np.random.default_rng(0)
    sequences, labels = [], []
    for _ in range(150):
        y = np.cumsum(rng.random(rng.integers(1, 12)) < 0.2) % 2
        sequences.append(np.stack([np.ones(len(y)), y + rng.normal(scale=0.6, size=len(y))], axis=1))
        labels.append(y)
    chain = fit_chain(sequences, labels)
    got = chain.decode(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    alone = (np.concatenate(sequences) @ chain.emission).argmax(axis=1)
    gold = np.concatenate(labels)
    assert (got == gold).mean() > 0.85 and (got == gold).mean() >= (alone == gold).mean()
    assert chain.transition[0, 0] + chain.transition[1, 1] > chain.transition[0, 1] + chain.transition[1, 0]


def corpus(n=120):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, quality = [], []
    for i in range(n):
        good = i % 3 > 0
        lines = [" ".join(word() for _ in range(rng.randint(6, 12))) + "." for _ in range(rng.randint(4, 8))]
        if not good:
            lines = [lines[0]] + [x.replace(" ", rng.choice([" | ", "### ", "$$$ "])) for x in lines[1:]]
        rows.append((i, "\n".join(lines)))
        quality.append((i, int(good)))
    return rows, quality


def test_documents_by_content_share(spark, docs_of):
    rows, quality = corpus()
    edge = [(None, rows[1][1]), (901, None), (902, ""), (903, "too few words"), (904, "same eight words again and again and on " * 9), rows[2], rows[2], (905, rows[0][1] + "\n" + rows[4][1] * 300)]
    docs = docs_of(rows + edge).withColumn("kept", F.lit("clash")).withColumn("judged", F.lit(1))
    labels = spark.createDataFrame([(i, q) for i, q in quality if i < 90] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = judge_documents(docs, labels).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == slow_stats(r.document.text)[:4]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    verdict = {r.document.doc_id: r.kept for r in out}
    held = [(i, q) for i, q in quality if i >= 90]
    assert all(verdict[i] == bool(q) for i, q in held)
    assert verdict[None] and not (verdict[901] or verdict[902] or verdict[903] or verdict[904])
    kept = keep_good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    again = judge_documents(docs.repartition(5), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert judge_documents(docs.limit(0), labels).collect() == []


def test_without_labels_the_base_rules_decide(spark, docs_of):
    rows, _ = corpus(12)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    docs = docs_of(rows)
    assert train_line_chain(docs, labels) is None
    assert all(r.kept and r.content_share == 1.0 for r in judge_documents(docs, labels).collect())


def test_repeated_rows_of_a_sampled_document_do_not_crowd_out_a_class(spark):
    rows = [(1, "One good line of words here.\nAnd another good line.")] * 300 + [(i, "Some words here.\nMore words there.") for i in range(2, 12)] + [(i, "$$$ ### |||\n!!! ***") for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i < 20)) for i, _ in set(rows)], "doc_id long, quality int")
    first, again = train_line_chain(docs, labels, per_class=15), train_line_chain(docs.repartition(3), labels, per_class=15)
    assert first is not None and (first.emission == again.emission).all()
