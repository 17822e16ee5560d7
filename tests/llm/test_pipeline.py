"""Every stage of the pipeline on what the one before kept, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jaccard import slow_similar
from test_line_dedup import expected as dedup_expected
from test_mixing import expected as mix_expected

import corpus_pipeline
from cohortflow.llm.line_crf import judge_documents
from cohortflow.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "source mixing", "packing"]

    good = stages["quality rules"](spark, docs, sf).collect()
    verdict = {r.document.doc_id: r.kept for r in judge_documents(docs, labels).collect()}
    assert sorted(r.doc_id for r in good) == sorted(i for i, kept in verdict.items() if kept)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert all(quality.get(r.doc_id, 1) == 1 for r in good) and len(good) > 100

    clean_df = stages["line dedup"](spark, spark.createDataFrame(good, docs.schema), sf)
    clean = clean_df.collect()
    assert clean_df.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in clean) == sorted((i, t) for i, t, _, _ in dedup_expected([(r.doc_id, r.text) for r in good]))

    single = stages["near dedup"](spark, spark.createDataFrame(clean, docs.schema), sf).collect()
    assert sorted(r.doc_id for r in single) == sorted({low for _, low in slow_similar([(r.doc_id, r.text) for r in clean])})
    assert {tuple(r) for r in single} <= {tuple(r) for r in clean}

    mixed = stages["source mixing"](spark, spark.createDataFrame(single, docs.schema), sf).collect()
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    want = mix_expected([(r.doc_id, r.text, r.lang, r.source) for r in single])
    assert {i: n for i, n in copies.items()} == {i: taken // size for i, size, _, _, taken in want if taken}

    packed = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), sf).collect()
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    total = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r.length for r in packed) == total
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and np.mean(list(ends.values())) > 3500

    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, packed))


def test_stages_on_odd_rows(spark, docs_of, tmp_path):
    """Null, empty and very long texts, repeated rows, null columns and clashing names go through every stage."""
    text = "These are some words of an ordinary text that says this and that about many things of no account, number {}."
    rows = [(i, text.format(i) + " and more words that only this text holds %d %d %d" % (i, i * 7, i * 31), "en", "a") for i in range(30)]
    rows += [(None, text.format("none"), None, None), (50, None), (51, ""), (52, " \n "), (53, "long words here " * 20_000, "en", "b"), rows[3], rows[3], (54, text.format("x"), None, None)]
    docs = docs_of(rows).withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("row_hash", F.lit("x")).withColumn("_row", F.lit(2)).withColumn("fp", F.lit(3))
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for part in (docs, docs.limit(0)):
        now = part
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            rows_out = out.collect()
            now = spark.createDataFrame(rows_out, out.schema)
        assert bool(rows_out) == bool(part.count())


def test_texts_reach_python_in_small_batches(spark, docs_of, sf):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "line dedup":  # no Python there
                spark.conf.set(key, "10000")
                stage(spark, docs_of([(1, "some words of a text"), (2, "other words of another text")]), sf)
                seen = [r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect()]
                assert sum(seen) == 3000 and max(seen) <= 500
        spark.conf.set(key, "100")  # a smaller bound of the user's stays
        corpus_pipeline.bound_batches(spark)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, "10000")
