import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortflow.llm.language_id import fit_language_model, identify_languages, subword_ids, train_language_model
from cohortflow.llm.queries import QUERIES


def test_subwords():
    joined = " ab é "
    slow = {joined[i:i + width] for width in (1, 2, 3) for i in range(len(joined) + 1 - width)} - {" "}
    assert len(set(subword_ids("Ab, 7É!", 1 << 40).tolist())) == len(slow)
    assert subword_ids("ab é", 64).tolist() == subword_ids(" AB--É ", 64).tolist()
    assert len(subword_ids("12 !? \n", 64)) == 0 and len(subword_ids("", 64)) == 0


def texts(seed, n=150):
    rng = random.Random(seed)
    alphabets = {"aa": "abcdeé", "bb": "cdefgß", "cc": "abfghñ"}
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    return [(" ".join(word(alphabets[g]) for _ in range(rng.randint(5, 40))), g) for g in rng.choices(list(alphabets), k=n)]


def test_model_learns_calibrates_and_folds():
    train, fresh = texts(1, 300), texts(2, 200)
    model = fit_language_model([t for t, _ in train], [g for _, g in train], buckets=512)
    table = model.tables()
    scored = [(model.probabilities(subword_ids(t, 512), table), g) for t, g in fresh]
    right = [model.languages[int(p.argmax())] == g for p, g in scored]
    assert np.mean(right) > 0.95
    accepted = [r for r, (p, _) in zip(right, scored) if p.max() >= model.threshold]
    assert len(accepted) > 100 and np.mean(accepted) > 0.97
    ids = subword_ids(fresh[0][0], 512)
    z = (model.embeddings[ids].mean(axis=0) @ model.weights + model.bias) / model.temperature
    assert np.allclose(model.probabilities(ids, table), np.exp(z) / np.exp(z).sum())


def test_documents(docs_of):
    rows = [(i, t, g) for i, (t, g) in enumerate(texts(3, 200))] + [(900, None, "aa"), (901, "", "bb"), (902, "123 ...", None), (None, "éaéa bcbc", None), (903, "abcé " * 300_000, None)]
    rows += [rows[0], rows[0]]
    docs = docs_of(rows).withColumn("score", F.lit("clash")).withColumn("document", F.lit(1))
    model = train_language_model(docs, per_language=100, buckets=256, epochs=6)
    out = identify_languages(docs, model).collect()
    by_id = {r.document.doc_id: r for r in out}
    assert len(out) == len(rows)
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) == ("und", 0.0, False)
    assert by_id[903].lang_pred == "aa" and 0 < by_id[903].score <= 1
    assert np.mean([r.lang_pred == r.document.lang for r in out if r.document.doc_id is not None and r.document.doc_id < 200]) > 0.95
    again = train_language_model(docs.repartition(6), per_language=100, buckets=256, epochs=6)
    assert np.array_equal(model.embeddings, again.embeddings) and model.threshold == again.threshold
    assert train_language_model(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in identify_languages(docs, None).collect()} == {"und"}
    assert identify_languages(docs.limit(0), model).collect() == []


def test_held_out_accuracy_on_the_given_table(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op7_language_id"](spark, sf).collect()
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95


def test_every_language_is_learned(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} text of it", f"lang{i:04d}") for i in range(1001)]
    model = train_language_model(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string"), max_texts=2002, epochs=1, buckets=256, width=4)
    assert len(model.languages) == 1001
