"""Base spans against the plain patterns, decoding and gradients against enumeration, recall beside base spans on the tables."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.personal_data import CARD, EMAIL, FEATURES, IP, KINDS, PHONE, SpanModel, base_spans, find_personal_data, islands, lattice, luhn, teaching_examples, train_span_model

# The patterns of the contract.
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if kind == IP else False, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def card(rng, size=16):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(size - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    letters = ["a", "Z", "9", "0", "25", ".", "@", "+", "-", " ", "(", ")", "_", "%", "\n", "é", "1.2.3.4", "a@b.c", "+1 (234) 555-6789", "4539578763621486", "300"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert base_spans(text) == slow_base(text), text
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000):
        base_spans(text)


def score_of(model, part, spans):
    """Sum of weights of one segmentation of an island, from its spans."""
    edges = {(part.places[s], k, part.places[e]): (s, e, x) for s, e, k, x in zip(part.start, part.stop, part.kind, part.features)}
    total, at, label, none = 0.0, 0, 4, 4
    for span in sorted(spans):
        s, e, x = edges[span]
        while at < s:
            total, label, at = total + model.transition[label, none], none, at + 1
        total += model.transition[label, span[1]] + model.segment[span[1]] @ x
        label, at = span[1], e
    while at < len(part.places) - 1:
        total, label, at = total + model.transition[label, none], none, at + 1
    return total


@pytest.mark.parametrize("text", ["a1@b.c 12", "1.2.3.4.5 6", "+1 23-456 78", "1234567 89@x.y"])
def test_decoding_finds_the_best_of_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    part = lattice(text)
    spans = [(part.places[s], int(k), part.places[e]) for s, e, k in zip(part.start, part.stop, part.kind)]
    assert spans
    for _ in range(5):
        model = SpanModel(rng.normal(0, 1, (4, len(FEATURES))), rng.normal(0, 1, (5, 5)))
        apart = lambda c: all(a[2] <= b[0] for a, b in itertools.combinations(sorted(c), 2))
        ways = [c for r in range(4) for c in itertools.combinations(spans, r) if apart(c)]
        for block in (2048, 2):
            got = model.decode(text, [], block)
            assert score_of(model, part, got) == pytest.approx(max(score_of(model, part, c) for c in ways))
        taken = model.decode(text, [(0, 3)])
        assert all(a >= 3 for a, _, _ in taken)


def test_training_tells_neighbours_apart_and_leaves_lookalikes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = train_span_model(docs)
    assert np.array_equal(train_span_model(docs.repartition(7)).segment, model.segment)
    rng = random.Random(6)
    missed = 0
    for _ in range(200):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        parts = rng.sample([(PHONE, phone), (CARD, card(rng)), (CARD, card(rng)), (IP, ".".join(str(rng.randint(1, 255)) for _ in range(4))), (EMAIL, "some.one.7@mail3.example.com")], rng.randint(2, 3))
        text, want = "word", []
        for kind, value in parts:
            want.append((len(text) + 1, kind, len(text) + 1 + len(value)))
            text += " " + value
        found = model.spans(text)
        base = base_spans(text)
        covered = lambda w: w in found or any(b[0] <= w[0] and w[2] <= b[2] for b in base)
        clash = lambda w: any(b[0] < w[2] and w[0] < b[2] for b in base)
        missed += sum(not covered(w) and not clash(w) for w in want)
        assert set(base) <= set(found)
    assert missed <= 4
    for text in ("on 2024-01-02 at 03:04", "1 2 3 4 5 6 7 8 9 10", "key 45bb0d53635bf1b89d4571475004921503", "key a4539578763621486 7b", "foo@bar", "300.301.302.303", "4539578763621487", "no digits at all"):
        assert model.spans(text) == base_spans(text)


def test_islands_hold_all_candidates():
    text = "x é1@b.c  +1 (234) 555-6789 4539578763621486\nend 12 a.b.c.d1"
    assert [t for _, t in islands(text)] == ["é1@b.c", "+1 (234) 555-6789 4539578763621486", "12 a.b.c.d1"]
    assert all(text[s:s + len(t)] == t for s, t in islands(text))
    assert teaching_examples([]) == []


def test_documents_with_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "+1 (208) 555-1177 4539578763621486"), (None, "mail a@b.co"), (3, "+1 (208) 555-1177 4539578763621486"), (4, "é 😀 9.8.7.6 " + "y" * 100_000 + " +12 345 678 90")]
    docs = docs_of(rows).withColumn("spans", F.lit(1)).withColumn("base", F.lit("x"))
    got = sorted([(r.doc_id, [(s.start, s.kind, s.end, s.base) for s in r.spans]) for r in find_personal_data(docs, None).collect()], key=repr)
    want = sorted([(i, [(a, KINDS[k], b, True) for a, k, b in slow_base(t or "")]) for i, t in rows], key=repr)
    assert got == want
    assert find_personal_data(docs.limit(0), None).collect() == [] and train_span_model(docs.limit(0)) is None and train_span_model(docs.filter("doc_id < 3")) is None
