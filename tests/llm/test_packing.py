import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.packing import first_fit_decreasing, pack_documents, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_decreasing_matches_a_scan_over_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(rng.choice([1, 5, 200]))]
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= lengths[i]
        want[i] = b
    assert first_fit_decreasing(lengths, 100) == [want[i] for i in range(len(lengths))]
    assert first_fit_decreasing([], 10) == []


def test_ids_equal_the_tokenizer(path):
    whole = tokenizers.Tokenizer.from_file(path)
    texts = ["", " \n", "a<|endoftext|>b c's it'S  Ünï é  x y ΑΣ ΑΣ. 12 3,4\u0085z \x1c q", "don't '\x0bs", "ÀÉ×÷ß ÿŸ. é é x_y a-b _ a_ (b) b) é.,! I'M he'll.' 日本語 \U0001f600!", "x" * 5000]
    for text in texts:
        assert np.frombuffer(token_ids(text.encode(), path), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    long_text = "Größe und dass 7 " * 200_000
    assert len(token_ids(long_text.encode(), path)) == 4 * 200_000 * len(whole.encode("Größe und dass 7 ", add_special_tokens=False).ids)


def test_pieces_cover_every_id_once_and_fit(docs_of, path):
    rng = random.Random(2)
    whole = tokenizers.Tokenizer.from_file(path)
    rows = [(i, " ".join(rng.choice(["the", "Thnd", "7", "été,"]) for _ in range(rng.randint(0, 120)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "word " * 3000), (None, "no id"), rows[4], rows[4]]
    docs = docs_of(rows).withColumn("ids", F.lit("clash")).withColumn("group", F.lit(0))
    out = pack_documents(docs, path, capacity=128, group_pieces=50, keep_ids=True).collect()
    want = sorted([(i, whole.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows], key=repr)
    by_doc, sequences = {}, {}
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, ids in want:
        pieces = sorted({(r.start, tuple(r.ids)) for r in by_doc[doc_id]})
        assert sum(map(list, (p for _, p in pieces)), []) == ids and all(r.doc_tokens == len(ids) for r in by_doc[doc_id])
    assert sum(r.length for r in out) == sum(len(ids) for _, ids in want)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert sum(r.length for r in out) / (128 * len(sequences)) > 0.93
    again = pack_documents(docs.repartition(5), path, capacity=128, group_pieces=50, keep_ids=True).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_crowded_group_and_empty_table(docs_of, path):
    docs = docs_of([(1, "the same row")] * 500)
    out = pack_documents(docs, path, capacity=40, group_pieces=20).collect()
    assert len(out) == 500 and len({(r.sequence_id, r.offset) for r in out}) == 500
    assert pack_documents(docs.limit(0), path).collect() == []
