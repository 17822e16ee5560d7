import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortflow.llm.mixing import mix_sources, mixed_documents, water_fill


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(rows, seed=17):
    """rows: (doc_id, text, lang, source); first fit in seeded order over whole sources, as plain lists."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    draw = lambda r: int(md5(f"{seed}:{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")[:12], 16)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size_of(r[1]) for r in rows if r[3] == s) for s in names}
    targets = dict(zip(names, water_fill([2 * total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(total.values()))))
    out = []
    for s in names:
        whole = int(targets[s] // total[s]) if total[s] else 0
        rest = targets[s] - whole * total[s] if whole < 2 else 0
        for r in sorted([r for r in rows if r[3] == s], key=lambda r: (draw(r), size_of(r[1]))):
            take = 0 < size_of(r[1]) <= rest
            rest -= size_of(r[1]) * take
            out.append((r[0], size_of(r[1]), total[s], targets[s], size_of(r[1]) * (whole + take)))
    return sorted(out, key=repr)


def sample_rows(n=300):
    rng = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.1) * 5) % 400)), "en", rng.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(n)]
    return rows + [(None, "one two", "en", "b"), (900, None, "en", "a"), (901, "", "en", "empty"), (902, None, "en", "empty")]


def test_water_fill():
    assert water_fill([100, 100, 100], [5, 2, 1], 80) == [50, 20, 10]
    got = water_fill([20, 100, 10], [5, 2, 1], 80)
    assert got[0] == 20 and got[2] == 10 and got[1] == pytest.approx(50)
    assert water_fill([1, 2], [5, 2], 100) == [1, 2] and water_fill([], [], 0) == [] and water_fill([0, 0], [5, 2], 0) == [0, 0]


def test_matches_brute_force(docs_of):
    rows = sample_rows()
    docs = docs_of(rows).withColumn("draw", F.lit("x")).withColumn("size", F.lit("clash")).withColumn("s", F.lit(1))
    out = mix_sources(docs)
    assert out.columns == docs.columns + ["source_size", "target", "taken", "repeats"]
    got = sorted([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out.collect()], key=repr)
    assert got == expected(rows)
    by_source = {}
    for r in out.collect():
        by_source.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r.size
    for rs in by_source.values():
        left_out = [r.size for r in rs if r.taken < 2 * r.size and r.repeats <= rs[0].target // max(1, rs[0].source_size)]
        assert 0 <= rs[0].target - sum(r.taken for r in rs) < min(left_out, default=2)
        assert all(r.repeats <= 2 for r in rs)


def test_a_document_of_half_its_source_is_filled_around(docs_of):
    """100 documents of 100 words and one of 10 000: whatever the order, less than one small document stays open."""
    rows = [(i, "w " * 100, "en", "a") for i in range(100)] + [(100, "w " * 10_000, "en", "a")]
    for seed in (17, 18, 21):
        taken = mix_sources(docs_of(rows), seed=seed).collect()
        assert 30_000 - 100 < sum(r.taken for r in taken) <= 30_000 and {r.repeats for r in taken} <= {1, 2}


def test_documents_without_words_are_not_repeated_too_often(docs_of):
    rows = [(1, "a b", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (4, "w " * 500, "en", "b"), (5, " \n", "en", "b")]
    got = {r.doc_id: r.repeats for r in mix_sources(docs_of(rows)).collect()}
    assert max(got.values()) <= 2 and got[2] == got[3]


def test_repeats_reruns_and_empty(docs_of):
    rows = sample_rows(60)
    rows += [rows[3], rows[3]]
    docs = docs_of(rows).withColumn("copy", F.lit("c"))
    once = sorted(map(str, mixed_documents(docs).collect()))
    again = sorted(map(str, mixed_documents(docs.repartition(7)).collect()))
    assert once == again
    taken = sum(r.repeats for r in mix_sources(docs).collect())
    assert len(once) == taken and mixed_documents(docs).columns == docs.columns
    assert mix_sources(docs.limit(0)).collect() == [] and mixed_documents(docs.limit(0)).collect() == []


def test_too_many_sources(docs_of, monkeypatch):
    monkeypatch.setattr("cohortflow.llm.mixing.MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mix_sources(docs_of([(i, "x", "en", f"s{i}") for i in range(4)]))
