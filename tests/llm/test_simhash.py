import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortflow.llm.simhash import Forest, components, drop_near_duplicates, fingerprint, key_plan, near_groups, near_links


def slow_print(text, words=4):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    tokens = [t for t in tokens if t]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    name = list(range(len(rows)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                name[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return sorted([(rows[i][0], prints[i], low.get(top(i))) for i in range(len(rows))], key=repr)


def sample_rows(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(40, 160))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "oNE  TWO"), (None, rows[0][1]), (None, "lonely text here"), rows[5], rows[5]]


def test_fingerprints():
    for _, text in sample_rows()[::9]:
        assert fingerprint(text) == slow_print(text)
    assert fingerprint("Größe Ä " * 3) == slow_print("Größe Ä " * 3)


def test_groups_match_brute_force(docs_of):
    rows = sample_rows()
    got = sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in near_groups(docs_of(rows)).collect()], key=repr)
    assert got == slow_groups(rows)


def test_tree_finds_all_neighbours():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 8, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 6), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in range(600)], dtype=np.uint64)
    values = np.unique(centres[rng.integers(0, 8, 600)] ^ flips)
    groups = (values >> np.uint64(61)).astype(np.int64)
    q, v = Forest(values, groups).search(values, groups, 4)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if groups[i] == groups[j] and int(values[i] ^ values[j]).bit_count() <= 4}
    assert set(zip(q.tolist(), v.tolist())) == want


def _classes(pairs):
    name = {}

    def top(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for a, b in pairs:
        name[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in list(name)}


def test_split_shards_and_finer_keys_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    flips = [int(np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 5), replace=False).astype(np.uint64))) for _ in range(500)]
    values = sorted({f ^ 0x123456789ABCDEF0 for f in flips})
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    want = _classes([(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4])
    for n, limit in ((500, 4096), (500, 40), (10**8, 4096)):
        got = _classes([(r.a % 2**64, r.b % 2**64) for r in near_links(df, n, 4, limit).collect()])
        assert got == want
    assert [key_plan(n, 4) for n in (10, 10**8, 10**11)] == [(5, 1), (6, 2), (7, 3)]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 200 + i) for i in range(50)]
    got = {r.v: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{v: 100 for v in [100, *range(200, 250)]}}


def test_one_row_per_group_stays(docs_of):
    rows = sample_rows()
    docs = docs_of(rows).withColumn("fp", F.lit("mine")).withColumn("id", F.lit("x"))
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    groups = slow_groups(rows)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted({g[2] for g in groups if g[2] is not None})
    assert [r.text for r in out.collect() if r.doc_id is None] == ["lonely text here"]
    assert drop_near_duplicates(docs.limit(0)).collect() == []
