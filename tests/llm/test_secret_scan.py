import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortflow.llm.secret_scan import CLASS_CHANGES, ENCODINGS, battery, false_discovery_levels, scan_secrets, sums_before, upper_tail

KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def slow_base(text):
    spans = [(m.start(), number, m.end(), kind) for number, (kind, rx, group, least) in enumerate(KINDS) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return sorted(spans)


def tail(z):
    x = abs(z)
    q = math.exp(-x * x / 2) / (math.sqrt(2 * math.pi) * (0.661 * x + 0.339 * math.sqrt(x * x + 5.51)))
    return q if z >= 0 else 1 - q


def slow_battery(token):
    bare = token.rstrip("=")
    hit = next(((n, a, e) for n, a, e in ENCODINGS if bare and set(bare) <= set(a)), None)
    if hit is None or len(bare) < 2:
        return None
    name, alphabet, equal = hit
    x = [alphabet.index(c) for c in bare]
    n, size, free = len(x), len(alphabet), len(alphabet) - 1
    chi = sum((x.count(i) - n / size) ** 2 / (n / size) for i in range(size))
    z_chi = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    side = [2 * v >= size for v in x]
    high, low, runs = sum(side), n - sum(side), 1 + sum(a != b for a, b in zip(side, side[1:]))
    mu = 2 * high * low / n + 1
    spread = (mu - 1) * (mu - 2) / (n - 1)
    z_runs = (runs - mu) / math.sqrt(spread) if spread > 0 else -math.sqrt(n)
    mean = sum(x) / n
    variance = sum((v - mean) ** 2 for v in x)
    z_serial = (sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / variance + 1 / n) * math.sqrt(n) if len(set(x)) > 1 else math.sqrt(n)
    p_random = min(1, 3 * min(tail(z_chi), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial))))
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in bare]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    shift = n * (size * equal - 1)
    z_even = (free + shift - chi) / math.sqrt(2 * (free + 2 * shift))
    z_change = (changes - (n - 1) * CLASS_CHANGES) / math.sqrt((n - 1) * CLASS_CHANGES * (1 - CLASS_CHANGES))
    return name, n, p_random, tail((z_even + z_change) / math.sqrt(2))


def slow_scan(rows, min_token=20, alpha=0.001, rate=0.01):
    seen = []
    for i, (_, text) in enumerate(rows):
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}={0,2}" % min_token, text or ""):
            b = slow_battery(m[0])
            if b:
                level = 0 if b[2] < alpha else math.floor(-10 * math.log10(max(b[3], 1e-30)))
                seen.append((i, m.start(), m.end(), f"{b[0]}:{int(math.log2(b[1]))}", level))
    spans = [slow_base(t) for _, t in rows]
    extra = [[] for _ in rows]
    for i, start, end, stratum, level in seen:
        peers = [s[4] for s in seen if s[3] == stratum]
        ok = any(10 ** (-g / 10) <= rate * sum(p >= g for p in peers) / len(peers) for g in set(peers) if g <= level)
        if ok and not any(b[0] <= start and end <= b[2] for b in spans[i]):
            extra[i].append((start, 3, end, "random"))
    return [(rows[i][0], sorted(spans[i] + extra[i])) for i in range(len(rows))]


def sample_rows():
    rng = random.Random(4)
    b64 = ENCODINGS[3][1]
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: pick("etaoinshrdlu", rng.randint(1, 9))
    parts = [
        lambda: f"token = \"{pick('0123456789abcdef', 40)}\"", lambda: "AKIA" + pick("ABCDEFGHIJKLMNOP0123456789", rng.randint(10, 20)), lambda: pick("0123456789abcdef", rng.randint(18, 70)),
        lambda: pick(b64, rng.randint(18, 90)) + "=" * rng.randint(0, 2), lambda: "-".join(word() for _ in range(6)), lambda: "PassWord:abc", lambda: "token=token:abcdefgh", lambda: "api_key='" + pick(b64, 9),
        lambda: "secret  secret= =x", lambda: "antidisestablishmentarianismus", lambda: "0" * 30, lambda: "abcdefghijklmnopqrstuvwxyz0123456789", lambda: "ſecret=abcdefg Key", lambda: "Größe \U0001f600",
    ]
    rows = [(i, " ".join(word() if rng.random() < 0.6 else rng.choice(parts)() for _ in range(rng.randint(0, 25)))) for i in range(150)]
    return rows + [(None, "passwd=hunter22"), (900, None), (901, ""), rows[7], rows[7]]


def test_matches_brute_force(docs_of):
    rows = sample_rows()
    docs = docs_of(rows).withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1)).withColumn("tokens", F.lit(2))
    got = sorted([(r.doc_id, [tuple(s) for s in r.spans]) for r in scan_secrets(docs).collect()], key=repr)
    assert got == sorted(slow_scan(rows), key=repr)
    kinds = [s[3] for _, spans in got for s in spans]
    assert all(kinds.count(k) > 5 for k in ("assign", "access", "hex", "random"))
    assert scan_secrets(docs.limit(0)).collect() == []


def test_battery_and_tail(spark):
    tokens = [t for _, text in sample_rows() for t in re.findall(r"[A-Za-z0-9+/_=-]{2,}", text or "")][:300] + ["aa", "=", "a=", "ab--+"]
    for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", battery(F.col("t")).alias("b")).collect():
        want = slow_battery(r.t)
        assert (want is None) == (r.b is None)
        if want:
            assert tuple(r.b) == (*want[:2], pytest.approx(want[2], rel=1e-6), pytest.approx(want[3], rel=1e-6))
    for r in spark.createDataFrame([(z / 4,) for z in range(-24, 25)], "z double").select("z", upper_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=0.004)


def test_sums_and_very_long_texts(spark, docs_of):
    values = [random.Random(1).randint(0, 9) for _ in range(3000)]
    got = spark.createDataFrame([(values,), (values[:1],), (values[:512],)], "v array<int>").select(sums_before(F.col("v")).alias("s")).collect()
    assert sorted(len(r.s) for r in got) == [1, 512, 3000] and all(r.s == [sum(values[:i]) for i in range(len(r.s))] for r in got)
    unit = "word token=abcdef12 " + "0123456789abcdef" * 3 + "\n"
    spans = scan_secrets(docs_of([(1, unit * 8000)])).collect()[0].spans
    assert len([s for s in spans if s.kind == "hex"]) == 8000 and spans[-1].end == len(unit) * 8000 - 1


def test_step_up_rule():
    assert false_discovery_levels([("a", 30, 2), ("a", 0, 8), ("b", 5, 3)], 0.01) == {"a": 30}
    assert false_discovery_levels([("a", 20, 1), ("a", 21, 1)], 0.01) == {"a": 20}
    assert false_discovery_levels([], 0.01) == {}


def test_sql_twin_says_the_same(spark, docs_of, tmp_path):
    import duckdb

    from cohortflow.llm.queries import QUERIES
    from cohortflow.llm.secret_sql import SECRETS_SQL

    rows = [r for r in {r[0]: r for r in sample_rows()}.values() if r[0] is not None and "ſ" not in (r[1] or "")]
    rng = random.Random(12)
    planted = {i: f"words {name}{''.join(rng.choice(ENCODINGS[3][1]) for _ in range(64))}== end" for i, name in enumerate(["PRIVATE_KEY=", "AccountKey==", "?sig=", "x=y="] * 5, 5000)}
    rows += list(planted.items())
    docs_of(rows, 1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(SECRETS_SQL)
    names = [d[0] for d in cur.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in cur.fetchall()}
    got = {r.doc_id: r.asDict() for r in QUERIES["op1_secret_scan"](spark, str(tmp_path)).collect()}
    assert got == want and sum(r["n_random"] for r in got.values()) > 5
    assert all(got[i]["n_random"] == 1 for i in planted)


def test_tokens_after_an_equals_sign(docs_of):
    rng = random.Random(9)
    pick = lambda: "".join(rng.choice(ENCODINGS[3][1]) for _ in range(60))
    names = ["PRIVATE_KEY=", "AccountKey=", "?sig=", "aws_secret_access_key=", "padded=="]
    rows = [(i, f"some words {names[i % 5]}{pick()}== and more") for i in range(50)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in scan_secrets(docs_of(rows)).collect()}
    for i, text in rows:
        start = text.index("=") + (2 if i % 5 == 4 else 1)
        assert (start, 3, start + 62, "random") in got[i]
