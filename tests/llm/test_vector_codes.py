"""Vector codes against plain integers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm import vector_codes
from cohortflow.llm.vector_codes import codebook_digest, component_limit, compress_vectors, exact_products, limb_bits, limbs

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def slow(rows, parts, entries, rounds=2):
    """All steps over Python integers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(v):
        return [min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        found = [assign(v) for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(kept, found) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, by = [], {}
    for i, v, label in kept:
        a = assign(v)
        error = sum(d for d, _ in a)
        by[label] = by.get(label, 0) + error
        out.append((i, label, "".join(f"{k:02x}" for _, k in a), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(*r, by[r[1]]) for r in out], key=repr), digest


def test_products_are_exact_near_the_limits():
    rng = np.random.default_rng(1)
    for width, top in ((1, 1 << 30), (4, 1 << 27), (64, 1 << 27), (3, 5)):
        a, b = rng.integers(-top, top, (20, width)), rng.integers(-top, top, (9, width))
        assert exact_products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        bits = limb_bits(width)
        assert width * ((1 << bits) - 1) ** 2 < 1 << 53
        assert (sum(x.astype(np.int64) << (bits * i) for i, x in enumerate(limbs(a, bits))) == a).all()
    one = np.array([[(1 << 27) + 1, -(1 << 27) + 1]])  # products that float64 alone would round
    assert exact_products(one, one)[0, 0] == ((1 << 27) + 1) ** 2 + ((1 << 27) - 1) ** 2
    assert 64 * (2 * component_limit(64)) ** 2 <= 1 << 62


@pytest.mark.parametrize("scale,entries", [(1.0, 6), (1e5, 6), (0.004, 40)])
def test_matches_plain_integers(spark, scale, entries):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, scale) for _ in range(8)], rng.choice([0, 0, 0, 1, None])) for i in range(90)]
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [float("nan")] * 8, 0), (203, [float("inf")] + [0.0] * 7, 0), (204, [], 0)]
    rows += [(None, [scale] * 8, 5), (None, [-scale] * 8, None), rows[3], rows[3], (3, [2 * scale] * 8, 1)]
    table = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("v", F.lit("clash")).withColumn("code", F.lit(1)).withColumn("error", F.lit("x"))
    out, books = compress_vectors(table, parts=4, entries=entries)
    want, digest = slow(rows, 4, entries)
    assert sorted([tuple(r) for r in out.collect()], key=repr) == want and codebook_digest(books) == digest


def test_few_rows_empty_tables_and_errors(spark, monkeypatch):
    rows = [(2, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (3, [5.0, 5.0], 2)]
    out, books = compress_vectors(spark.createDataFrame(rows, ROWS), parts=2, entries=64)
    assert [r.code for r in out.orderBy("vec_id").collect()] == ["0000", "0000", "0202"] and books.shape == (2, 3, 1)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, compress_vectors(spark.createDataFrame(rows, ROWS), parts=2)[0].collect())) == sorted(map(tuple, out.collect()))
    empty, none = compress_vectors(spark.createDataFrame([(1, None, 1)], ROWS), parts=2)
    assert empty.collect() == [] and none is None and codebook_digest(none) == hashlib.sha256(b"").hexdigest()
    for bad in ([(1, [1.0] * 3, 1)], [(1, [1e30, -1e300], 1)]):
        with pytest.raises(Exception, match="ValueError|components|length"):
            compress_vectors(spark.createDataFrame(bad, ROWS), parts=2)
