import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.metric_search import Tree, exact_top_k, integer_vector


def slow(rows, queries, k):
    out = []
    for q_id, q in sorted(set((i, tuple(v)) for i, v in queries if i is not None and v is not None)):
        scored = sorted(((sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i is not None and v is not None and i != q_id), key=lambda s: (-s[0], s[1]))[:k]
        out += [(q_id, r + 1, i, s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_best(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-50, 50, (700, 6)).astype(float) if seed else np.repeat(rng.integers(-3, 3, (5, 6)), 140, axis=0).astype(float)
    ids = rng.permutation(700)
    top = (rows**2).sum(axis=1).max()
    tree = Tree(ids, rows, top, leaf=16, fan=4)
    for i in range(0, 700, 41):
        want = sorted(((int(rows[j] @ rows[i]), int(ids[j])) for j in range(700) if j != i), key=lambda s: (-s[0], s[1]))[:5]
        assert tree.search(int(ids[i]), rows[i], 5) == want
        assert tree.search(int(ids[i]), rows[i], 5, want[-1][0]) == want
    visited = sum(len(p[1]) for p in tree.pages if p[0])
    assert visited == 700


def test_query_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randint(-256, 256) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [255, -3, 7, 9, 0, 1, 2, 3]) for i in range(150)]  # copies: many ties
    rows += [(2000, [1, 2]), (2001, []), (2002, [0] * 8), (None, [1] * 8), (2003, None), rows[5], (2004, [2**40] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("cell", F.lit("clash")).repartition(4)
    queries = [r for r in rows if r[0] is not None and (r[0] % 50 == 0 or r[0] > 1999)] + [rows[0], (5000, [1] * 8)]
    asked = spark.createDataFrame(queries, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in exact_top_k(vectors, asked, k=5, page=32, max_pivots=6, block=7).collect())
    limit = 2**63 - 1
    assert got == [(q, r, i, min(limit, s)) for q, r, i, s in slow(rows, queries, 5)]
    assert exact_top_k(vectors, asked.limit(0)).collect() == [] and exact_top_k(vectors.limit(0), asked).collect() == []
    few = exact_top_k(vectors.filter("vec_id < 3"), asked.filter("vec_id = 0")).collect()
    assert [r.rank for r in few] == [1, 2]


def test_integer_vectors(spark):
    rows = [([0.5, -0.001],), (None,), ([1.0, None],), ([float("nan")],), ([float("inf"), 1.0],), ([],), ([1e-9, -1e-9, 2.0],)]
    got = [r.v for r in spark.createDataFrame(rows, "e array<float>").select(integer_vector(F.col("e")).alias("v")).collect()]
    assert got == [[128, -1], None, None, None, None, [], [0, -1, 512]] and math.floor(256 * -0.001) == -1
