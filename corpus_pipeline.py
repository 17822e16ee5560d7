"""Training-data pipeline over documents: every stage works on what the one before kept.

Every stage takes null, empty and very long texts, null ids and sources, repeated rows, empty tables and further columns of
any name; what becomes of them is stated with the operator it calls. Texts without words end at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm.jaccard import drop_similar
from cohortflow.llm.line_crf import keep_good_documents
from cohortflow.llm.line_dedup import dedup_lines
from cohortflow.llm.mixing import mixed_documents
from cohortflow.llm.packing import pack_documents
from cohortflow.llm.queries import tokenizer_path
from cohortflow.session import BATCH_ROWS, bound_batches, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with a bound on the rows sent to Python at once. Its result is computed later, so the session keeps the bound."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line model is trained on the table `labels`. Null or empty text: dropped."""
    return keep_good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; a text of such lines alone stays as an empty one. Columns of documents."""
    return dedup_lines(docs).select(*docs.columns)


@in_small_batches
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more); columns of documents.

    Texts without words are one group; rows without a doc_id are grouped like others, and one stays where no row of the group has one."""
    return drop_similar(docs)


@in_small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, repeated rows one by one; columns of documents."""
    return mixed_documents(docs)


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the mixed documents in sequences of 4096 ids."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("source mixing", mixing_stage), ("packing", packing_stage),
]

#: No SQL: the stages train a model, hash shingles and call a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = bound_batches(spark)
    try:
        for name, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            path = scratch_path(spark, name.replace(" ", "-"))
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return docs
