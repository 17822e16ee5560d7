import random
from collections import defaultdict

from pyspark.sql import functions as F

from cohortflow.llm.line_dedup import dedup_lines

WHITE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WHITE).translate(LOW)
    least = -10**18
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(least if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and (least if doc_id is None else doc_id) != max(holders[key(x)]))]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()], key=repr)


def test_matches_brute_force(docs_of):
    rng = random.Random(3)
    pool = [f"{c}hared passage number {i} of the Größe {'x' * (i % 9)}" for i, c in enumerate("SsTtUuVv" * 3)] + ["short", "", " ", "\t a line with blanks around it \r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(None, None), (None, pool[0]), (500, None), (501, ""), (502, "\n\n"), (7, "other text of the same id\n" + pool[0]), rows[3], rows[3]]
    assert result(dedup_lines(docs_of(rows))) == expected(rows)


def test_long_text_clashing_columns_and_empty_table(docs_of):
    shared = "a licence line that stands in many documents"
    long_text = "\n".join([shared, "unique line of the long text"] * 20_000)
    rows = [(1, long_text), (2, shared.upper()), (3, f"  {shared}\nrest")]
    docs = docs_of(rows).withColumn("n_lines", F.lit(-1)).withColumn("pos", F.lit("p")).withColumn("h1", F.lit("h"))
    out = dedup_lines(docs)
    assert out.columns == docs.columns + ["n_dropped"]
    assert result(out) == expected(rows)
    assert {r.pos for r in out.collect()} == {"p"}
    assert dedup_lines(docs.limit(0)).collect() == []
