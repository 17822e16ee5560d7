"""Boundary sets against sorted lists, examples against slices of strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.infilling import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, container, fill_in_middle, restored


def slow(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return doc_id, n, "spm", i, j - i, f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}"
    return doc_id, n, "psm", i, j - i, f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"


@pytest.mark.parametrize("share,kind", [(0.01, ArrayContainer), (0.5, BitmapContainer), (1.0, RunContainer)])
def test_containers_select_like_sorted_lists(share, kind):
    member = np.random.default_rng(3).random(1 << 16) < share
    held, count = container(member)
    places = np.nonzero(member)[0]
    assert isinstance(held, kind) and count == len(places)
    assert [held.select(r) for r in range(0, count, 97)] == places[::97].tolist() and held.select(count - 1) == places[-1]
    assert container(np.zeros(5, bool))[1] == 0


def test_boundaries_of_long_mixed_texts():
    rng = random.Random(5)
    parts = ["a" * 70_000, "".join(rng.choice("aé漢😀") for _ in range(90_000)), "́" * 3, "é" * 80_000, "x" + "漢" * 40_000]
    for text in [*parts, "".join(parts), "", "a" * 65_535, "a" * 65_536, "é" * 32_768]:
        found = BoundarySet(np.frombuffer(text.encode(), np.uint8))
        assert len(found) == len(text) + 1
        for rank in {0, len(text), len(text) // 2, *[rng.randint(0, len(text)) for _ in range(50)]}:
            assert found.select(rank) == len(text[:rank].encode())
    kinds = {type(c) for c in BoundarySet(np.frombuffer("".join(parts).encode(), np.uint8)).containers}
    assert {RunContainer, BitmapContainer} <= kinds


def test_examples_match_slices(docs_of):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab é漢😀<PSM>\n") for _ in range(rng.choice([0, 1, 2, 30, 300])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "has <M> inside"), (None, "no id"), (None, None), rows[7], rows[7], (1003, "é" * 200_000), (1004, "<P<S<M")]
    docs = docs_of(rows).withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    made = fill_in_middle(docs)
    got = sorted([tuple(r) for r in made.collect()], key=repr)
    want = [slow(*r) for r in rows]
    assert got == sorted(want, key=repr) and {r[2] for r in want} == {"plain", "psm", "spm"}
    back = made.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
    assert fill_in_middle(docs.limit(0)).collect() == []
