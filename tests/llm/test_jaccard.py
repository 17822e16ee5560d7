import random

import pytest

import corpus_pipeline
from cohortflow.llm import jaccard
from cohortflow.llm.jaccard import drop_similar, least_size, parities, shingles, similar_groups


def slow_set(text, words=5):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    tokens = [t for t in tokens if t]
    return {tuple(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def slow_similar(rows):
    """Smallest doc_id of every row's group, over all pairs."""
    sets = [slow_set(t) for _, t in rows]
    name = list(range(len(rows)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                name[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return sorted([(rows[i][0], low.get(top(i))) for i in range(len(rows))], key=repr)


def sample_rows(seed=5):
    """Texts around the limit: a few words changed or cut, a passage that many share, lengths from 1 word."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 9, 40, 100, 160]))] for _ in range(45)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words = words[:rng.randint(1, len(words))]
        if rng.random() < 0.3:
            words += passage
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "oNE  TWO"), (None, rows[0][1]), (None, "lonely text here"), rows[5], rows[5]]


@pytest.mark.parametrize("common", [5, 10**6])
def test_groups_match_all_pairs(docs_of, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = sample_rows()
    got = sorted([(r.doc_id, r.component_id) for r in similar_groups(docs_of(rows)).collect()], key=repr)
    assert got == slow_similar(rows)


def test_pairs_at_the_limit(docs_of):
    """Two cuts of one text: 264 of 328 shingles shared is near, 263 of 329 is not."""
    words = [f"v{i}" for i in range(400)]
    for cut, want in ((32, {1}), (33, {1, 2})):
        rows = [(1, " ".join(words[:300])), (2, " ".join(words[cut:300 + cut]))]
        assert {r.component_id for r in similar_groups(docs_of(rows)).collect()} == want == {low for _, low in slow_similar(rows)}
    assert [least_size(n) for n in (1, 2, 5, 6, 10, 296)] == [1, 2, 4, 5, 8, 237]


def test_stage_drops_copies_that_differ_in_more_than_four_bits(spark, docs_of):
    from cohortflow.llm.simhash import fingerprint

    rng = random.Random(1)
    words = [rng.choice([f"w{i}" for i in range(500)]) for _ in range(120)]
    other = list(words)
    other[30] = other[80] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "some other text of several words")]
    assert (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() > 4 and slow_similar(rows) == [(1, 1), (2, 1), (3, 3)]
    docs = docs_of(rows)
    out = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert drop_similar(docs.limit(0)).collect() == []


def test_one_row_of_every_group_stays(docs_of):
    """Also where rows of a group have no doc_id, or one doc_id stands on several near texts."""
    rng = random.Random(2)
    base = [[f"b{i}w{rng.randrange(10_000)}" for _ in range(150)] for i in range(6)]
    near = lambda i, j: " ".join([*base[i][:j], "new", *base[i][j + 1:]])
    rows = [(None, near(0, j)) for j in (3, 60, 100, 100)]  # nobody has a name
    rows += [(7, near(1, j)) for j in (5, 80)] + [(None, near(1, 120))]  # one name, two texts
    rows += [(7, near(2, 9)), (8, near(2, 70)), (8, near(2, 70))]  # the same name in another group
    rows += [(None, near(3, 10)), (None, near(4, 10)), (9, near(5, 10)), (9, near(5, 10)), (None, None), (None, " "), (None, "")]
    got = drop_similar(docs_of(rows)).collect()
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    groups = sorted((str(r.doc_id), (r.text or "").strip()[:2]) for r in got)
    assert groups == [("7", "b1"), ("7", "b2"), ("9", "b5"), ("None", ""), ("None", "b0"), ("None", "b3"), ("None", "b4")]
    again = drop_similar(docs_of(rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_stage_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, sf).collect()) == sorted({low for _, low in slow_similar(rows)})


def test_texts_around_one_passage_do_not_meet(spark, docs_of, monkeypatch):
    """A passage of 120 words with own tails, similarity 0.76: the pairs that are formed do not grow with the square of the texts."""
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10_000)}" for _ in range(120))
    rows = [(i, passage + " " + " ".join(f"t{rng.randrange(100_000)}" for _ in range(18))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)]
    sizes = {}
    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: sizes.setdefault(name, []).append(keep(df, name)) or sizes[name][-1])
    got = {r.doc_id: r.component_id for r in similar_groups(docs_of(rows)).collect()}
    assert got == {i: (i - 1000 if i >= 1000 else i) for i, _ in rows}
    assert 20 <= sum(p.count() for p in sizes["pairs"]) < 1000


def test_a_group_of_near_copies_is_not_expanded_into_pairs(docs_of, monkeypatch):
    rng = random.Random(8)
    words = [f"c{rng.randrange(10_000)}" for _ in range(150)]
    rows = [(i, " ".join(words[:j] + [f"x{i}"] + words[j + 1:])) for i, j in enumerate(rng.randrange(150) for _ in range(300))]
    sizes = {}
    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: sizes.setdefault(name, []).append(keep(df, name)) or sizes[name][-1])
    assert {r.component_id for r in similar_groups(docs_of(rows)).collect()} == {0}
    assert sum(p.count() for p in sizes["pairs"]) < 600  # of 44 850


def test_parity_bits_differ_in_no_more_places_than_the_sets():
    rng = random.Random(4)
    for n in (1, 30, 400, 3000):
        words = [f"w{rng.randrange(50)}" for _ in range(n)]
        other = [w if rng.random() < 0.9 else "x" for w in words]
        a, b = (shingles(" ".join(t)) for t in (words, other))
        differ = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view("uint64"))
        assert differ <= len(set(a) ^ set(b)) and (differ - len(set(a) ^ set(b))) % 2 == 0
    assert not parities(shingles("")).any()


def test_fingerprints_in_trees_propose_links_first(docs_of, monkeypatch):
    from cohortflow.llm import simhash

    rng = random.Random(9)
    rows = [(i, " ".join(f"a{i}w{rng.randrange(10_000)}" for _ in range(400))) for i in range(12)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(12)]
    sizes, searched = {}, []
    keep, trees = jaccard.written, jaccard.near_links
    monkeypatch.setattr(jaccard, "written", lambda df, name: sizes.setdefault(name, []).append(keep(df, name)) or sizes[name][-1])
    monkeypatch.setattr(jaccard, "near_links", lambda values, n, radius: searched.append(n) or trees(values, n, radius))
    assert {r.doc_id: r.component_id for r in similar_groups(docs_of(rows)).collect()} == {i: i % 100 for i, _ in rows}
    close = sum((simhash.fingerprint(rows[i][1], 5) ^ simhash.fingerprint(rows[12 + i][1], 5)).bit_count() <= 4 for i in range(12))
    assert searched == [len({jaccard.majority(shingles(t)) for _, t in rows})] and close > 6
    assert close - 1 <= sizes["proposed"][0].count() <= 12 and sizes["links"][0].count() == 12 == sum(p.count() for p in sizes["pairs"])


def test_texts_move_once(spark, docs_of, monkeypatch, tmp_path):
    """Only texts asked for meet the pairs, shingles are shuffled once, and the last step shuffles whole rows once; the other way gives the same links."""
    rows = sample_rows()
    docs_of(rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plans, keep = {}, jaccard.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard, "written", lambda df, name: plans.setdefault(name, []).append(plan(df)) or keep(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = plan(drop_similar(docs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans["sets"]) == 3 and all("BroadcastHashJoin" in p and p.count("Exchange hashpartitioning") == 1 for p in plans["sets"])
    assert plans["shared"][0].count("Exchange hashpartitioning") == 1
    assert last.count("Exchange hashpartitioning(key") == 2 and "partial_first" in last and last.count("Exchange") == 4
    monkeypatch.setattr(jaccard, "SENT", -1)
    assert sorted([(r.doc_id, r.component_id) for r in similar_groups(docs).collect()], key=repr) == slow_similar(rows)
